"""Types of small books, by hand."""

from chronofold.operators.book_profile import book_types


def test_types(spark):
    story = "he said and went " * 140  # 560 words, 280 verbs
    books = {
        "novel": [("One", story)] * 3, "chapters": [("Chapter IV", "he said and she left " * 10)] * 4, "play": [("Act II", "HAMLET: ay. Exeunt")] * 4,
        "verse": [("Sonnet 3", "o rose")] * 4, "tales": [("A Tale", story)] * 4, "manual": [("Lesson 1", "turn it")] * 4, "lecture": [("Lecture I", "x " * 400)] * 4, "plain": [(None, None), ("x", "y")],
        "mixed": [("Sonnet 3", "o rose")] * 4 + [("Lesson 1", "turn it")] * 4,
    }
    rows = [(b, t, x) for b, parts in books.items() for t, x in parts]
    got = {r.book_id: (r.book_type, r.confidence) for r in book_types(spark.createDataFrame(rows, "book_id string, title string, text string")).collect()}
    assert got == {
        "novel": ("novel", 0.94), "chapters": ("novel", 0.76), "play": ("drama", 0.99), "verse": ("poetry", 0.98), "tales": ("anthology", 0.95),
        "manual": ("reference", 0.98), "lecture": ("nonfiction", 0.9), "plain": ("unknown", 0.4), "mixed": ("unknown", 0.64),
    }
