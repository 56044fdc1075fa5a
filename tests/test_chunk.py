import random

import pytest

from pagewright import chunk
from tests.model import chunks


def M(n):
    return f"<!-- page_number: {n} -->"


def run(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    out = {}
    for r in chunk(docs, ["doc_id"], **kw).orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append((r.content, r.header, r.header_level, r.header_path, r.page_numbers))
    return [out.get(i, []) for i in range(len(texts))]


GOLDEN = {
    "basic": ("# Header 1\nContent 1.\n## Header 2\nContent 2.\n", [("# Header 1\nContent 1.", "Header 1", 1, "Header 1", [1]), ("## Header 2\nContent 2.", "Header 2", 2, "Header 1 > Header 2", [1])]),
    "empty": ("", [("", None, 0, "", [1])]),
    "late page": (M(5) + "\nonly", [("only", None, 0, "", [1, 5])]),
    "cleanup": (M(1) + "\nClean text.", [("Clean text.", None, 0, "", [1])]),
    "cross line": ("#\n## Foo\nx", [("#\n## Foo\nx", "## Foo", 1, "## Foo", [1])]),
    "fence": ("```\n# not a header\n```", [("```", None, 0, "", [1]), ("# not a header\n```", "not a header", 1, "not a header", [1])]),
    "seven": ("####### x", [("####### x", None, 0, "", [1])]),
    "marker in title": (f"# H {M(4)}\nb", [("# H \nb", f"H {M(4)}", 1, f"H {M(4)}", [1, 4])]),
    "assembled": (f"\n{M(1)}\n\n# P1\na\n\n{M(2)}\n\n# P2\nb", [("", None, 0, "", [1]), ("# P1\na", "P1", 1, "P1", [1, 2]), ("# P2\nb", "P2", 1, "P2", [2])]),
}


def test_golden(spark):
    got = run(spark, [t for t, _ in GOLDEN.values()])
    for (name, (_, want)), have in zip(GOLDEN.items(), got):
        assert have == want, name


def test_skipped_levels(spark):
    assert [c[3] for c in run(spark, ["# A\n### C\n## B\n# D"])[0]] == ["A", "A > C", "A > B", "D"]


def test_random_documents_agree_with_the_model(spark):
    rnd = random.Random(3)
    bits = ["# A", "## B ", "### C", "#", "####### x", "\n", "\n", "\r", " ", " ", "\x0b", "\x85", "text", M(2), M(7), "<!--page_number:3-->", "```", "#tag", " ", "", "é"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 30))) for _ in range(1500)]
    for text, have in zip(texts, run(spark, texts)):
        assert have == chunks(text), repr(text)


def test_null_drop_empty_and_document_columns(spark):
    docs = spark.createDataFrame([(1, None, "s", "old")], "doc_id int, content string, source string, header string")
    rows = chunk(docs, ["doc_id"]).collect()
    assert [(r.content, r.source, r.header) for r in rows] == [("", "s", None)]
    assert chunk(docs, ["doc_id"], drop_empty=True).count() == 0


def test_plan_has_one_exchange_and_no_python(spark):
    docs = spark.createDataFrame([(1, "# a")], "doc_id int, content string")
    plan = chunk(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", [3000])
def test_many_sections(spark, n):
    assert len(run(spark, ["\n".join(f"{'#' * (1 + k % 6)} h{k}\nx" for k in range(n))])[0]) == n
