from __future__ import annotations

from vellumgrid.llm import line_templates

SCHEMA = "doc_id long, text string, line_no int, line_h long, template string"


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text, r.n_dropped) for r in line_templates.deduplicated(docs).collect()), key=str)


def test_matches_sql(same):
    same(line_templates.query, line_templates.ORACLE)


def test_variable_fields_and_first_occurrence(spark):
    line = "login event for user {} from host {} at the main gate today"
    rows = [(1, line.format("anna", "h1") + "\nown words of the first document"), (2, "before\n" + line.format("bert", "h2")), (3, line.format("carl", "h3") + "\n" + line.format("dora", "h4") + "\nafter")]
    assert kept(spark, rows) == [(1, rows[0][1], 0), (2, "before", 1), (3, "after", 2)]


def test_edges(spark):
    long = "w" * 100_000
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long + " " + "tail " * 20_000), (5, "it.\n5 5"), (6, "it"), (None, "a null id")]
    assert kept(spark, rows) == sorted([(d, t, 0) for d, t in rows], key=str)
    assert kept(spark, []) == []
    same_id = [(1, "one two three four five six seven eight nine"), (1, "one two three four five six seven eight nine")]
    assert [r[2] for r in kept(spark, same_id)] == [0, 0]


def test_one_rule_for_lines_of_every_length(spark):
    for tokens in range(1, 12):
        line = " ".join(f"t{chr(97 + k)}" for k in range(tokens))
        rows = [(k, f"{line}\nown{chr(97 + k)} {chr(97 + k)}") for k in range(3)]
        assert [r[2] for r in sorted(kept(spark, rows))] == [0, 1, 1]
    rows = [(1, "see also the north\nx"), (2, "see also the south\ny"), (3, "see also a west\nz")]
    assert [r[2] for r in sorted(kept(spark, rows))] == [0, 1, 0]


def test_rows_without_ids_are_documents(spark):
    line = "a passage that several documents without an id hold"
    rows = [(None, f"{line}\none"), (None, f"{line}\ntwo"), (None, f"{line}\ntwo"), (4, f"zero\n{line}")]
    assert kept(spark, rows) == sorted([(None, "one", 1), (None, "two", 1), (None, "two", 1), (4, rows[3][1], 0)], key=str)


def test_hot_lines_are_dealt(spark):
    rows = [(k, f"the common line of all documents here\nown{chr(97 + k % 26)}{chr(97 + k // 26)} text") for k in range(400)]
    out = sorted(kept(spark, rows))
    assert [r[2] for r in out] == [0] + [1] * 399


def test_many_lines_in_one_document(spark):
    lines = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(15_000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join(lines))]
    assert kept(spark, rows) == [(1, rows[0][1], 0), (2, "\n".join(lines[1::2]), 7500)]


def test_leaf_with_several_templates(spark):
    """Families of equal size and lone lines in one leaf: nothing has a majority."""
    heads = ["alpha beta gamma delta epsilon", "one two three four five", "red green blue white black"]
    lone = [f"we saw the {' '.join(f'lone{chr(97 + k)}{chr(97 + j)}' for j in range(7))}" for k in range(6)]
    lines = [f"we saw the {h} {w} end" for h in heads for w in ("left", "right")]
    rows = [(k, x) for k, x in enumerate(lines + lone)]
    assert [r[2] for r in sorted(kept(spark, rows), key=lambda r: r[0])] == [0, 1] * 3 + [0] * 6
    # an edited copy of a line that the vote places, itself too far from the template
    voted = [f"we saw the a b c d {x} {y} z" for x, y in (("p", "q"), ("r", "s"), ("t", "u"), ("v", "w"))]
    rows = [(k, x) for k, x in enumerate([*voted, "we saw the a b e f p q z"])]
    assert [r[2] for r in sorted(kept(spark, rows), key=lambda r: r[0])] == [0, 1, 1, 1, 1]


def test_passages_without_blanks(spark):
    passage = "".join(chr(0x4E00 + 7 * k) for k in range(150))
    rows = [(1, f"{passage}\na few words"), (2, f"before\n{passage}\na few words")]
    assert kept(spark, rows) == [(1, rows[0][1], 0), (2, "before", 2)]
