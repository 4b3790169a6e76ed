"""The corpus pipeline, stage by stage and whole, against plain Python."""

import random
import shutil
from collections import Counter

import pytest
from test_minmax import brute
from test_texts import corpus

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, run string, copies string"


def rows_():
    """Good and bad texts by label, copies, near copies, nulls, and rows that share an id or have none."""
    rng = random.Random(31)
    texts, labels = corpus(5, 420)
    good, rows = {i for i, q, _ in labels if q}, []
    for i, t in texts:
        rows.append((i, t))
    own = [t for i, t in texts if i in good]
    for k in range(60):
        w = own[k % 7].split()
        if k % 2:
            w[rng.randrange(len(w))] = "other"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, own[20]) for k in range(80)]  # a hot text
    rows += [(None, own[30]), (None, own[31] + " more"), (5, own[32] + " once more"), (5, own[33]), rows[0], rows[0]]
    rows += [(3000, None), (3001, ""), (3002, " \n")]
    return [(i, t, "en", ["a", "b", "c", None][k % 4] if k % 3 else "a", None, "x", "y", "z") for k, (i, t) in enumerate(rows)], good, own


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows in order, each made from what was kept before."""
    rows, good, own = rows_()
    docs, kept = spark.createDataFrame(rows, SCHEMA), [("documents", rows)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, "unused"), name)
        kept.append((name, [tuple(r) for r in docs.collect()]))
        if name != "tokenize":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return dict(kept), good, set(own)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "tokenize"]


def test_quality_keeps_good_rows_whole(stages):
    kept, good, own = stages
    left, had = Counter(kept["quality"]), Counter(kept["documents"])
    assert not left - had  # rows as they were, none invented
    gone = {r[0] for r in (had - left)}
    labelled = [r for r in kept["documents"] if r[0] is not None and r[0] < 420 and r[0] != 5]
    wrong = [r[0] for r in labelled if (r[0] in gone) == (r[0] in good)]
    assert len(wrong) <= 0.03 * len(labelled)
    assert all(left[r] == had[r] for r in kept["documents"] if r in left)


def test_exact_dedup_keeps_one_row_a_text(stages):
    kept, _, _ = stages
    before, after = kept["quality"], kept["exact_dedup"]
    want = {}
    for r in before:
        key = (r[0] is not None, r[0] or 0)
        want[r[1] or ""] = min(want.get(r[1] or "", key), key)
    assert not Counter(after) - Counter(before)
    assert {r[1] or "": (r[0] is not None, r[0] or 0) for r in after} == want and len(after) == len(want)


def test_near_dedup_keeps_one_document_a_group(stages):
    kept, _, _ = stages
    before, after = kept["exact_dedup"], kept["near_dedup"]
    component, _ = brute([(r[0], r[1]) for r in before if r[0] is not None], 5, 80)
    want = [r for r in before if r[0] is None or component[r[0]] == r[0]]
    assert Counter(after) == Counter(want) and len(after) < len(before)


def test_mix_meets_targets(stages):
    from test_dedup_mix_chat import plain_targets

    kept, _, _ = stages
    before, after = Counter(kept["near_dedup"]), Counter(kept["mix"])
    size = lambda r: len((r[1] or "").split())
    totals, taken, longest = Counter(), Counter(), Counter()
    for r, n in before.items():
        totals[r[3]] += n * size(r)
        taken[r[3]] += after[r] * size(r)
        longest[r[3]] = max(longest[r[3]], size(r))
        assert after[r] <= 2 * n
    assert set(after) <= set(before)
    for source, target in plain_targets(dict(totals)).items():
        assert abs(taken[source] - target) <= longest[source]


def test_tokens_are_the_library_s_and_decode_exactly(stages):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from unblend.llm import bpe

    kept, _, _ = stages
    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r[0], r[2], r[3], tuple(own.encode_ordinary(r[1] or ""))) for r in kept["mix"])
    assert Counter((i, lang, source, tuple(ids)) for i, lang, source, _, ids, _ in kept["tokenize"]) == want
    assert all(n == len(ids) and exact for _, _, _, n, ids, exact in kept["tokenize"])


def test_run_is_the_stages_one_after_another(spark, stages, tmp_path):
    rows, _, _ = rows_()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    key = lambda r: repr(r)
    assert sorted(map(key, got)) == sorted(map(key, stages[0]["tokenize"]))
    shutil.rmtree(tmp_path / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
