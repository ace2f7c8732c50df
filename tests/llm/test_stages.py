"""Each pipeline stage on odd tables: nulls in any column, empty and long texts, repeated rows, clashing names, no rows."""

import pytest

import corpus_pipeline

from ..conftest import SF

CLASH = ("kept", "row", "id", "t", "n_words", "failed_bits", "gone", "doc", "component_id", "h1", "a b")
LONG = "\n".join(f"line {i} of a very long document goes on with words {i * 7} and {i * 13}" for i in range(4000))
ROWS = [
    (1, LONG, "en", "s", 1), (2, LONG, None, None, None), (2, LONG, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0),
    (None, LONG[:3000], "en", "s", 5), (5, " \n\t", "en", "s", 3), (6, "few words", "en", "s", 9), (7, " ".join(f"own{i}" for i in range(50)), "en", None, 9),
    (8, " ".join(f"two{i}" for i in range(50)), "en", "b", 9), (8, " ".join(f"two{i}" for i in range(50)), "en", "a", 9),
]


def table(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *["x" if i % 2 else None for i in range(len(CLASH))]) for r in rows], schema)


#: Rows left of ROWS, by their ids, as each docstring has it.  The long text repeats windows of eight words.
LEFT = {
    "quality_rules": [7, 8, 8],
    "line_dedup": [1, 2, 2, 3, 4, 5, 6, 7, 8, 8, None],
    "minhash_near_dedup": [1, 3, 4, 5, 6, 7, 8, None],
    "benchmark_decontamination": [1, 2, 2, 3, 4, 5, 6, 7, 8, 8, None],
    "bpe_encoding": [1, 2, 2, 3, 4, 5, 6, 7, 8, 8, None],
}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    docs = table(spark, ROWS)
    out = stage(spark, docs, SF)
    if name != "bpe_encoding":
        assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x)) == LEFT[name]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_no_rows(spark, name, stage):
    assert stage(spark, table(spark, []), SF).count() == 0


def test_near_copies_of_four_fifths_go(spark):
    """Pairs of similarity 0.8, 0.82 and 0.79: texts of n + 4 words whose last k differ share n - k shingles of n + k."""
    rows = []
    for g in range(20):
        for part, (n, k) in enumerate([(90, 10), (100, 10), (100, 12)]):
            words = [f"g{g}p{part}w{i}" for i in range(n + 4)]
            rows += [(100 * g + 10 * part, " ".join(words)), (100 * g + 10 * part + 1, " ".join(words[:-k] + [w + "x" for w in words[-k:]]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()}
    assert {i for i, _ in rows} - left == {100 * g + 10 * part + 1 for g in range(20) for part in (0, 1)}
