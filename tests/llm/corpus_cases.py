"""Rows and names that the tests of the corpus operators share."""

SF = "/root/testdata/sf0.001"

#: Names that operators use inside, as extra columns of a table.
CLASHES = ["place", "size", "start", "id", "key", "digest", "rank", "band", "score", "n", "file", "row", "_metadata", "words", "block",
           "__text", "__score", "__place", "__gone", "__at", "__slot", "__turn", "__start", "__part", "__words"]

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text))
