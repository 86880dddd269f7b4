import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_text_operators import brute_components
from varigrid.llm import bpe, decontamination, minhash_dedup, queries


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        if name == "bpe":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            assert len(after) > 0.97 * len(before)
        if name == "near_dedup":
            assert minhash_dedup.near_duplicates(docs).filter("NOT kept").count() == 0
        if name == "decontamination":
            assert decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
        if name == "secret_scan":
            assert set(after) == set(before)
            assert all("AKIA" not in t for t in after.values())
        before = after
    e = bpe.encoder(bpe.default_path())
    assert {r.doc_id: r.n_tokens for r in docs.collect()} == {i: len(e.encode(t)) for i, t in before.items()}


def test_near_dedup_links_from_eight_tenths(spark):
    """Common starts of 204 words of 200 shingles; a pair's own ends have n shingles each, so similarity is 200 / (200 + 2n)."""
    rows = []
    for k, n in enumerate([20, 22, 24, 25, 26, 30] * 5):
        start = " ".join(f"w{k}s{i}" for i in range(204))
        rows += [(10 * k + j, start + "".join(f" w{k}e{j}x{i}" for i in range(n))) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    gone = {10 * k + 1 for k, n in enumerate([20, 22, 24, 25, 26, 30] * 5) if n <= 25}
    assert kept == {i for i, _ in rows} - gone


def test_stages_with_odd_rows_against_brute_force(spark, sf_dir, odd_rows):
    """Nulls in all columns, empty and repeated rows, a long text, clashing names; then an empty table."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(3).collect()
    key = "AKIA" + "Q7" * 8
    rows = [*odd_rows, (70, f"{prose(7, 60)} {benchmark[0].text} {prose(8, 60)}"), (71, f"é {prose(9, 80)} {key} token='abcdef12'"), (70, None), (72, prose(9, 500)), (72, prose(9, 500))]
    more = [("aa" if k % 2 else None, None if k % 3 else "s", k if k % 4 else None, k, k, "h", None) for k in range(len(rows))]
    docs = spark.createDataFrame([(*r, *m) for r, m in zip(rows, more, strict=True)], "doc_id long, text string, lang string, source string, n_chars long, block int, _leak long, _gone string, _part int")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"odd-{name}")
        after = [tuple(r) for r in out.collect()]
        if name == "language_id":  # one language: what has a letter is sure
            assert sorted(after, key=repr) == sorted((r for r in before if r[1] and any(c.isalpha() for c in r[1])), key=repr)
        elif name == "near_dedup":
            kept = [k for *_, k in brute_components([r[:2] for r in before], 80)]
            gone = {r[0] for r, k in zip(before, kept, strict=True) if not k}
            assert sorted(after, key=repr) == sorted((r for r in before if r[0] is None or r[0] not in gone), key=repr)
        elif name == "decontamination":
            holds = {r[0] for r in before if r[0] is not None and any(" ".join(lower_words(b.text)) in " ".join(lower_words(r[1])) for b in benchmark)}
            assert holds == {70}
            assert sorted(after, key=repr) == sorted((r for r in before if r[0] not in holds), key=repr)
        elif name == "secret_scan":
            text = dict((r[0], r[1]) for r in after)
            assert sorted(r[0] or -1 for r in after) == sorted(r[0] or -1 for r in before)
            assert key not in text[71] and "abcdef12" not in text[71] and text[71].startswith("é ")
            assert all(r[4] == len(r[1]) for r in after)
        else:
            e = bpe.encoder(bpe.default_path())
            assert sorted((r.doc_id or -1, r.n_tokens) for r in out.collect()) == sorted((r[0] or -1, len(e.encode(r[1]))) for r in before)
            break
        assert out.columns == columns
        seen[name], docs = len(after), out
    assert seen["language_id"] > seen["near_dedup"] > seen["decontamination"] == seen["secret_scan"]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def lower_words(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).decode().split(" ")


def test_queries_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf_dir)
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(got.columns), name
        assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect()), name
    con.close()


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
