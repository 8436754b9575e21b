"""Every registered corpus query on a written folder of tables: SQL where there is some, else brute force."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from __spark_entry__ import oracle_sql, queries
from fleetscope.llm import chunking, secrets
from fleetscope.llm.queries import QUERIES
from fleetscope.llm.tokens import encoder
from tools.compare import rows_of

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
COLUMNS = {
    "op1_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_source_mixing": "doc_id size source_size target taken",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_url_filter": "page_id host path rule verdict",
    "op5_simhash_near_dedup": "doc_id fingerprint component_id",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_language_model_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_centroid_clustering": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op12_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13_benchmark_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
}


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    key = "AKIA" + "Q7" * 8
    rows = [*corpus, (70, f'token = "abcdef9" {key}\n<P> marked', "s1"), (71, "one\n\ntwo\nthree", "s1"), (72, corpus[9][1].upper(), "s2")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n long")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    words = corpus[9][1].split()
    items = [(1, " ".join(words[5:25])), (2, " ".join(words[18:40])), (10, "one two"), (11, None), (12, "..."), (None, " ".join(words[30:42])), (1, "zzz absent " * 6), (13, "one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, int(k < 50)) for k in [*range(25), 50, 57]], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    urls = [None, "", "x", "HTTP://WWW.Example.NET/en/a?b#c", "http://example.net?en/"] + [
        f"http://{h}.example.{t}/{p}/{k}" for k, (h, t, p) in enumerate((h, t, p) for h in ("a", "m.b") for t in ("net", "com", "org") for p in ("en", "de", "fr") for _ in range(6))]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    rng = np.random.default_rng(4)
    vectors = [(k, [float(x) for x in rng.normal(k % 5, 0.3, 64)]) for k in range(150)]
    vectors += [(150, vectors[3][1]), (3, vectors[3][1]), (151, None), (152, [1.0] * 63), (153, [1.0] * 63 + [float("nan")]), (154, [1.0] * 63 + [float("inf")]), (155, [0.5] * 63 + [None]), (None, [0.25] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return at, rows, urls


def found(spark, folder, name):
    df = QUERIES[name](spark, folder[0])
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    return df.collect()


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS) and set(QUERIES) | {"pipeline"} <= set(queries())


@pytest.mark.parametrize("name", [n for n in COLUMNS if n in oracle_sql()])
def test_query_matches_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder[0])
    cursor = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert df.columns == columns == COLUMNS[name].split()
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_secrets(spark, folder):
    rows = {r["doc_id"]: r for r in found(spark, folder, "op1_secret_scan")}
    text = {k: t or "" for k, t, _ in folder[1]}
    for k, r in rows.items():
        base = [f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in secrets.base_spans(text[k])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) or not base
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
    assert (rows[70]["n_assign"], rows[70]["n_access"], rows[70]["n_hex"]) == (1, 1, 0) and rows[51]["spans"] == ""


def test_mix(spark, folder):
    rows = found(spark, folder, "op2_source_mixing")
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((k, len((t or "").encode().split())) for k, t, _ in folder[1])
    assert all(r["taken"] == r["size"] * len(r["shards"]) <= 3 * r["size"] for r in rows)
    again = found(spark, folder, "op2_source_mixing")
    assert Counter((r["doc_id"], r["taken"], tuple(r["shards"])) for r in rows) == Counter((r["doc_id"], r["taken"], tuple(r["shards"])) for r in again)


def test_packing(spark, folder):
    expected = Counter()
    for k, text, _ in folder[1]:
        ids = [*encoder("byte_bpe_50k.json").whole.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[k, number, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = found(spark, folder, "op3_best_fit_packing")
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected


def test_urls(spark, folder):
    for r in found(spark, folder, "op4_url_filter"):
        fits = [x for x in RULES if (r["host"] == x[0] or r["host"].endswith("." + x[0])) and r["path"].startswith(x[1])]
        rule = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert r["rule"] == (rule[0] + rule[1] if rule else None) and r["verdict"] in ("allow", "block")
        assert rule is None or r["verdict"] == rule[2]
    verdicts = {r["verdict"] for r in found(spark, folder, "op4_url_filter") if r["rule"] is None}
    assert verdicts == {"allow", "block"}, "the trees say something of their own"


def test_quality(spark, folder):
    for r in found(spark, folder, "op9_quality_rules"):
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_simhash(spark, folder):
    rows = found(spark, folder, "op5_simhash_near_dedup")
    assert len(rows) == len(folder[1]) and {len(r["fingerprint"]) for r in rows} == {16}
    at = {r["doc_id"]: r for r in rows}
    assert at[50]["fingerprint"] == "0" * 16 == at[51]["fingerprint"] and at[40]["component_id"] == 0 and at[72]["fingerprint"] == at[9]["fingerprint"]


def test_scores_and_fingerprints(spark, folder):
    rows = found(spark, folder, "op8_language_model_scores")
    assert len(rows) == len(folder[1]) and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    rows = {r["doc_id"]: r for r in found(spark, folder, "op10_document_fingerprints")}
    text = {k: (t or "") for k, t, _ in folder[1]}
    assert all(r["n_chars"] == len(text[k]) and r["fingerprint"] == chunking.written(chunking.chunk_sets([text[k].encode()])[0]) for k, r in rows.items())
