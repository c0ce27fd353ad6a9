"""The pipeline against a plain version on a small folder of tables."""

import random

import public_tokenizers
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(rng.randrange(30, 200))) for k in range(200)]
    question = text(14)
    rows += [(300 + k, rows[k][1]) for k in range(5)] + [(310, rows[6][1].upper()), (311, rows[7][1] + " "), (312, f"before {question} after " + text(20))]
    rows += [(313 + k, rows[20 + k][1].replace(rows[20 + k][1].split()[3], "edited")) for k in range(4)]
    rows += [(320 + k, f"{text(40)} grumbleface {text(5)} snotbag") for k in range(60)] + [(400, None), (401, ""), (402, " ")]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int("grumbleface" in (t or ""))) for k, t in rows if k % 2 == 0], "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, question), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, dict(rows), question


def test_stages_equal_a_plain_version(spark, folder):
    out, rows, question = folder
    left = {k: t or "" for k, t in rows.items() if "grumbleface" not in (t or "")}
    by_text = {}
    for k, t in left.items():
        by_text[t.lower()] = max(k, by_text.get(t.lower(), k))
    left = {k: left[k] for k in by_text.values()}
    cut = {k: t.lower().split() for k, t in left.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w} for k, w in cut.items()}
    kept = {}
    for k in sorted(left):
        # in these texts no group is linked over a third document only
        if not any(len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j in kept):
            kept[k] = left[k]
    kept = {k: t for k, t in kept.items() if question not in t}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, out).collect()}
    assert got.keys() == kept.keys()
    assert all(got[k].text == t and got[k].n_tokens * 4 == len(got[k].ids) for k, t in kept.items())
    assert 312 not in got and 310 in got and 6 not in got and not {320, 350} & got.keys()


def test_stages_keep_every_different_row(spark, folder):
    """Rows without id, of one id, and columns named like the stages' own: only copies go."""
    rows = [(None, f"text number {k} of its own kind here") for k in range(20)] + [(7, f"row {k} of one shared id") for k in range(5)] + [(None, "text number 3 of its own kind HERE")]
    docs = spark.createDataFrame([(k, t, 1, 2, 3, "x") for k, t in rows], "doc_id long, text string, _id int, _sha int, _place int, component string")
    once = corpus_pipeline.drop_exact_copies(spark, docs, folder[0])
    assert once.columns == docs.columns
    assert len({r.text.lower() for r in once.collect()}) == once.count() == 25
    assert corpus_pipeline.drop_near_copies(spark, once, folder[0]).count() == 25
    assert corpus_pipeline.drop_near_copies(spark, docs, folder[0]).count() == 25


def test_stages_keep_columns_and_survive_odd_tables(spark, folder):
    out = folder[0]
    empty = spark.createDataFrame([], DOCS)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5)], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, out).columns == empty.columns
        assert stage(spark, empty, out).count() == 0
        kept = stage(spark, odd, out)
        assert kept.schema.simpleString() == odd.schema.simpleString()
        assert kept.count() == (2 if "dedup" in name else 3)
    assert corpus_pipeline.STAGES[-1][1](spark, odd, out).count() == 3
    assert public_tokenizers.PATTERN
