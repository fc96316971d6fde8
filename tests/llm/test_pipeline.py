import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from chronolake.llm import jaccard_join, language_id, quality, suffix_dedup
from chronolake.llm.suffix_dedup import PASSAGE as LENGTH

SYLLABLES = {"aa": ["ka", "lo", "mi", "tes"], "bb": ["zwö", "fix", "grt", "sol"]}


def write(spark, folder):
    rng = random.Random(3)
    vocabulary = {k: ["".join(rng.choice(s) for _ in range(rng.randrange(1, 5))) for _ in range(60)] for k, s in SYLLABLES.items()}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = []
    for i in range(260):
        lang = "aa" if i % 2 else "bb"
        rows.append([i, prose(lang, rng.randrange(40, 160)), lang])
    passage = prose("aa", 130)
    for i in (11, 21, 31):
        rows[i][1] += " " + passage
    rows += [[300 + i, rows[i][1], rows[i][2]] for i in range(0, 40, 4)]  # copies
    near = rows[50][1].split()
    near[3] = "lokami"
    rows.append([400, " ".join(near), "bb"])
    rows += [[500, None, "aa"], [501, "123 ...", None], [502, "", "bb"], [None, prose("aa", 50), None]]
    rows += [[600 + i, "Q%d## " % i * 40, "aa"] for i in range(6)]
    docs = spark.createDataFrame([(*r, "src", len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(240)] + [(600, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_run_equals_the_stages_by_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs = write(spark, folder)
    # the first two stages decide by model: their row-wise operators say what is left
    told = {r.doc_id for r in language_id.keep_identified(docs).collect()}
    assert told <= {r.doc_id for r in language_id.predictions(docs).collect() if r.lang_pred != "und" and r.score >= 0.3}
    left = docs.where(docs.doc_id.isin([i for i in told if i is not None]) | docs.doc_id.isNull())
    good = {r.doc_id for r in quality.judged(left, quality.labels_of(spark, folder)).collect() if r.keep}
    texts = {r.doc_id: r.text for r in left.collect() if r.doc_id in good}
    assert 500 not in texts and 501 not in texts and 600 not in texts and len(texts) > 250
    # near duplicates
    sets = {i: frozenset(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) for i, t in texts.items()}
    group = {i: i for i in texts}
    order = sorted(texts, key=lambda i: (i is None, i))
    for a in order:
        for b in order:
            if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low = min(group[a], group[b], key=lambda i: (i is None, i))
                group = {k: low if v in (group[a], group[b]) else v for k, v in group.items()}
    texts = {i: texts[i] for i in set(group.values())}
    assert 400 not in texts and 300 not in texts
    # repeated strings
    data = {i: t.encode() for i, t in texts.items()}
    seen = Counter(d[k : k + LENGTH] for d in data.values() for k in range(len(d) - LENGTH + 1))
    cut = {}
    for i, d in data.items():
        gone = set()
        for k in range(len(d) - LENGTH + 1):
            if seen[d[k : k + LENGTH]] > 1:
                gone |= set(range(k, k + LENGTH))
        cut[i] = bytes(x for k, x in enumerate(d) if k not in gone).decode("utf-8", "ignore")
    assert sum(len(cut[i]) < len(texts[i]) for i in cut) == 3
    # packing
    peer, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in cut.items():
        ids = peer.encode(t, add_special_tokens=False).ids + [0]
        pieces += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    out = corpus_pipeline.run(spark, folder).toPandas()
    key = lambda r: (-1 if r[0] is None or r[0] != r[0] else int(r[0]), *map(int, r[1:]))
    assert sorted(map(key, out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, pieces))
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    docs = write(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    assert jaccard_join.THRESHOLD == 0.8 and suffix_dedup.LENGTH == 400 and suffix_dedup.PASSAGE < 50 * 6


def test_no_documents_give_no_pieces(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder + "/full").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{folder}/full/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_clashing_columns_are_carried(spark, tmp_path):
    folder = str(tmp_path)
    names = ["_id", "_1", "_t1", "t1", "k1", "c0", "c1", "c", "v", "of", "own", "limit", "spans", "data", "removed_", "margin", "score", "lang_pred", "group", "bands"]
    docs = write(spark, folder)
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        rows = out.select("doc_id", *names).collect()
        assert rows and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in names), name


def test_a_very_long_text(spark, tmp_path):
    """Three million characters in one row are read whole by every operator that has a model or sets."""
    from chronolake.llm import maxent_lm

    folder = str(tmp_path)
    docs = write(spark, folder)
    base = docs.where("doc_id = 7").first().text + " "
    long = spark.createDataFrame([(9000, base * (3_000_000 // len(base)), "aa", "src", 3_000_000), (9001, base * (3_000_000 // len(base)), "aa", "src", 3_000_000)], docs.schema)
    both = docs.unionByName(long)
    words = len(base.split()) * (3_000_000 // len(base))
    told = {r.doc_id: r for r in language_id.predictions(both).collect()}
    assert told[9000].lang_pred == "aa" == told[9001].lang_pred
    good = {r.doc_id: r for r in quality.judged(both, quality.labels_of(spark, folder)).collect()}
    assert good[9000].n_tokens == words and good[9000].keep
    links = {r.doc_id: r for r in jaccard_join.links_by_document(both).collect()}
    assert links[9000].class_id == links[9001].class_id and links[9001].n_links >= 1
    scores = {r.doc_id: r for r in maxent_lm.scores(both).collect()}
    assert scores[9000].n_tokens == words + 1 and scores[9000].score == scores[9001].score < 0


def test_the_quality_stage_learns_from_all_trusted_documents(spark, tmp_path, monkeypatch):
    """A sample of one document would know none of the words that tell prose from junk."""
    monkeypatch.setattr(quality, "SAMPLE", 1)
    rng = random.Random(3)
    words = ["".join(rng.choices(["ka", "lo", "mi", "tes"], k=5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=60)), "en") for i in range(200)]
    rows += [(1000 + i, " ".join("".join(rng.choices("qwxzk", k=6)) for _ in range(60)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.where("doc_id < 1000").selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.judge_quality(spark, docs, str(tmp_path)).collect()}
    assert sum(i < 1000 for i in kept) >= 195 and not any(i >= 1000 for i in kept)
