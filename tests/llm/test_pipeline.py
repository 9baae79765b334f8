"""The pipeline's stages on a small table with planted cases, and the registered queries."""

import random
import time
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from gridloom.llm import mail, queries
from gridloom.llm.shared import scratch, settle, shared_folder, stored


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    clean = [" ".join(word() for _ in range(80)) + "." for _ in range(150)]
    passage = " ".join(word() for _ in range(70))
    texts = clean + clean[:5] + [f"{clean[10]} {passage}", f"{passage} {clean[11]}"] + [" ".join(word() + "$$$" for _ in range(60)) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    junk = range(157, 197)
    labels = [(i, int(i not in junk), 0) for i in range(0, 197, 2)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stored(stage(spark, now, str(tmp_path)))
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns and now.count() <= before.count()
    good = {r[0] for r in seen["quality"].select("doc_id").collect()}
    assert len(good & set(junk)) == 0 and len(set(range(150)) - good) <= 3
    unique = {r[0] for r in seen["near_duplicates"].select("doc_id").collect()}
    assert not unique & set(range(150, 155)) and unique >= good & set(range(150))
    cut = {r[0]: r[1] for r in seen["repeated_substrings"].select("doc_id", "text").collect()}
    assert passage in cut[155] and passage not in cut[156]
    assert seen["repeated_substrings"].where(F.coalesce(F.length("text"), F.lit(0)) != F.col("n_chars")).count() == 0
    whole = seen["repeated_substrings"].agg(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))) + 1)).first()[0]
    assert seen["packing"].agg(F.sum("n_tokens")).first()[0] == whole
    assert corpus_pipeline.run(spark, str(tmp_path)).exceptAll(seen["packing"]).count() == 0


def test_stages_on_odd_tables(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = [(1, text[0]), (1, text[0]), (2, text[1]), (None, text[2]), (None, text[0]), (3, None), (4, ""), (5, f"{text[1]} {text[3]}"), (6, " ".join([text[4]] * 300))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, name string, block long, importance string"
    full = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", "n", 7, "i") for i, t in rows], schema)
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 5)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((full, full.limit(0))):
        path = tmp_path / str(k)
        docs.write.parquet(str(path / "documents.parquet"))
        labels.write.parquet(str(path / "labels.parquet"))
        now = spark.read.parquet(str(path / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, str(path)))
            if name != "packing":
                assert now.columns == docs.columns
                ids = sorted((r[0] for r in now.collect()), key=lambda i: (i is None, i))
                if not k:
                    # All have words but 3 and 4; rows of the kept id stay, the null one with its text goes.
                    assert ids == ([1, 1, 2, 5, 6, None, None] if name == "quality" else [1, 1, 2, 5, 6, None])
        assert (now.count() == 0) == bool(k)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def _bytes(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_stages_leave_little_on_disk(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(4000)) for _ in range(150)]
    docs = stored(spark.createDataFrame(list(enumerate(texts + texts[:50])), "doc_id long, text string"))
    places = [shared_folder(spark).removeprefix("file:"), spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")]
    tables, before = set(t.name for t in spark.catalog.listTables()), sum(map(_bytes, places))
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    # The result needs ids alone; texts, prefixes and pairs are gone.
    assert sum(map(_bytes, places)) - before < 20_000 and set(t.name for t in spark.catalog.listTables()) == tables
    assert kept.count() == 150
    with mail.released():
        corpus_pipeline.without_repeats(spark, kept, "")
        (name,) = set(t.name for t in spark.catalog.listTables()) - tables
        table = spark.table(name)
        held = table.select(*(F.sum(F.octet_length(f.name)) for f in table.schema if f.dataType.simpleString() == "string")).first()
        # Each text is written once.
        assert sum(held) == sum(map(len, texts))


def test_settled_queries_leave_no_shuffle_files(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {p for d in folders for p in Path(d.getPath()).rglob("shuffle_*.data")}
    some = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    with scratch(spark) as keep:
        for write in (settle, stored, keep):
            before = files()
            assert write(some).count() == 7
            # Files are removed while the next job runs; that of the count is not in question.
            begun = time.time()
            while len(files() - before) > 1 and time.time() < begun + 20:
                time.sleep(0.2)
            assert len(files() - before) <= 1
    assert "spark.sql.classic.shuffleDependency.fileCleanup.enabled" not in spark.conf.getAll
