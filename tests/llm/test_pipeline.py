import random

import corpus_pipeline
from pathloom.llm import secrets
from tests.llm.helpers import NASTY
from tests.llm.test_bpe_packing import check_pieces
from tests.llm.test_quality import made_rows


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = made_rows(240)
    words = [f"term{rng.randrange(4000)}" for _ in range(3000)]
    passage = " ".join(words[:60])
    extra = [(900 + k, " ".join(words[100 * k : 100 * k + 90]) + " " + passage + " " + " ".join(words[100 * k + 90 : 100 * k + 99])) for k in range(4)]
    extra += [(1000, " ".join(words[1000:1200])), (1001, " ".join(words[1000:1200])), (1002, " ".join(words[1000:1200]).upper())]
    extra += [(1100, "see password=abcdef123456 here " + " ".join(words[1300:1400])), (1200, "such a scum idiot, you idiot. you moron. scum idiot idiot " + " ".join(words[1500:1560]))]
    every = [r for r in NASTY if r[0] is not None] + [(i + 2000, t) for i, t in rows] + extra
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long, gram int")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i + 2000, q, x) for i, q, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    texts, at = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        texts[name] = {r.doc_id: r.text for r in at.collect()}
    toxic = {i + 2000 for i, _, x in labels if x}
    assert 1200 not in texts["toxicity"] and len(toxic & set(texts["toxicity"])) <= 0.1 * len(toxic)
    clean = {i for i, _ in every} - toxic - {1200}
    assert len(clean & set(texts["toxicity"])) >= 0.98 * len(clean)
    assert 1000 in texts["near_copies"] and not {1001, 1002} & set(texts["near_copies"]) and {900, 901, 902, 903, 1100} <= set(texts["near_copies"])
    assert set(texts["repeats"]) == set(texts["near_copies"]) and all(" ".join(words[5:55]) not in (texts["repeats"][k] or "") for k in (900, 901, 902, 903))
    assert texts["repeats"][1000] == dict(every)[1000]
    assert "[SECRET]" in texts["secrets"][1100] and not any(secrets.find(t or "") for t in texts["secrets"].values())
    assert all(r.n_chars == len(r.text) for r in at.collect() if r.text is not None)

    pieces = corpus_pipeline.run(spark, folder).collect()
    from tokenizers import Tokenizer

    import public_tokenizers as P

    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    check_pieces(pieces, {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts["secrets"].items()})


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("row", "rest", "kept", "packed", "ranges", "gram", "span", "blob", "spans", "own", "masked", "sig", "fp", "stays", "id", "hash", "own_id", "own_hash", "label", "key", "unit", "x", "score", "__text", "no_text", "a`b")


def tables(spark, folder, rows, labels, more=()):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(more))) for i, t in rows], COLUMNS + "".join(f", `{n.replace('`', '``')}` int" for n in more))
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return frame


def test_empty_documents_and_labels(spark, tmp_path):
    tables(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edges(spark, tmp_path):
    """Null ids, null, empty and repeated rows, one id with two texts, and columns with clashing names, without any label."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(20_000))
    rows = [(None, "one text without an id, long enough to stand for itself"), (1, None), (2, ""), (3, "plain words of a text"), (3, "plain words of a text"), (3, "another text under the same id, with words of its own"), (4, long), (None, None)]
    folder = str(tmp_path)
    frame = tables(spark, folder, rows, [], CLASHES)
    at = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, folder)
        assert out.columns == frame.columns, name
        out.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        seen[name] = at.collect()
        assert all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in seen[name])
    assert sorted(map(repr, ((r.doc_id, r.text) for r in seen["toxicity"]))) == sorted(map(repr, rows))
    kept = {(r.doc_id, r.text) for r in seen["near_copies"]}
    assert kept == {rows[0], rows[1], rows[3], rows[5], rows[6]} and len(seen["near_copies"]) == 5  # empty and null texts are one group, repeated rows stay once
    assert {(r.doc_id, r.text) for r in seen["secrets"]} == kept
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == 1 and len({r.doc_id for r in pieces}) == 4
