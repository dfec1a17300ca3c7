"""The operators as queries over the driver's tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, html_text, merkle, minhash, pieces, quality, runs, secrets, tokenstore, toxicity, url_rules, vectors
from .storage import session_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Shingling(width=3, num=85))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session_folder(spark, "op3")
    tokenstore.write_store(_table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return tokenstore.read_summary(spark, path)


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), digests).drop("text")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other kind of match that op8's index gives: all words of a window close together, in any order."""
    return decontaminate.proximity_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op10_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The stretch that op12 repeats in a tenth of the texts; a null id has none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), planted_tail)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs are by start and period, so the first of equal exponents stays
    top = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("1000L * top.length div top.period")
    return out.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # wide enough for one more than the largest number
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, n_chars + 1).otherwise(n_chars)
    return merkle.manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id", {"n_chars": tampered}).drop("path")


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_quality_discriminant": op2_quality_discriminant,
    "op3_token_store": op3_token_store,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity_machine": op6_toxicity_machine,
    "op7_sentencepiece_codec": op7_sentencepiece_codec,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "benchmark_proximity": benchmark_proximity,
    "op9_html_extraction": op9_html_extraction,
    "op10_url_association_rules": op10_url_association_rules,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op11_hidden_markov": op11_hidden_markov,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


def _spelled(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_spelled, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: DuckDB has no crc32: bit by bit over the decimal digits.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

#: DuckDB SQL of the operators that it can express; it compares all pairs and all windows.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN n ON id = a""",
    "op4_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), c AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS common FROM u p JOIN u q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c WHERE 100 * common >= 85 * (na + nb - common)), nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN component ON doc_id = id""",
    "op8_benchmark_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, s + 1, s + least(10, len(w))), ' ') AS win FROM (SELECT item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw), dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s + 1, s + n), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "benchmark_proximity": f"""WITH dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
i AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark), win AS (SELECT item_id, s AS w, least(10, len(i.w)) AS n, list_distinct(list_slice(i.w, s + 1, s + least(10, len(i.w)))) AS ws FROM (SELECT item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0) i),
ww AS (SELECT item_id, w, n, len(ws) AS k, unnest(ws) AS word FROM win), c AS (SELECT doc_id, item_id, w FROM (SELECT DISTINCT doc_id, word FROM dw) JOIN ww USING (word) GROUP BY doc_id, item_id, w HAVING count(*) = any_value(k)),
p AS (SELECT c.doc_id, c.item_id, c.w, n, k, pos, ww.word FROM c JOIN ww ON c.item_id = ww.item_id AND c.w = ww.w JOIN dw ON dw.doc_id = c.doc_id AND dw.word = ww.word),
m AS (SELECT DISTINCT p.doc_id, p.item_id, p.w FROM p JOIN p q ON p.doc_id = q.doc_id AND p.item_id = q.item_id AND p.w = q.w AND q.pos BETWEEN p.pos AND p.pos + p.n + 4 GROUP BY p.doc_id, p.item_id, p.w, p.pos, p.k HAVING count(DISTINCT q.word) = p.k)
SELECT doc_id, CAST(item_id AS VARCHAR) AS item_id, CAST(count(*) AS BIGINT) AS windows FROM m GROUP BY ALL""",
    "op13_merkle_manifest": f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS other FROM documents),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, leaf, coalesce(other, leaf) AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up AS (SELECT g, 0 AS l, i, n, leaf AS h FROM d UNION ALL SELECT g, l + 1, i // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, l + 1, i // 2),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS l, i, n, subroot AS h FROM s UNION ALL SELECT l + 1, i // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l + 1, i // 2),
low AS (SELECT d.g, d.i, list(CASE WHEN (d.i >> k.l) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(b.h, '') ORDER BY k.l) AS p FROM d JOIN (SELECT DISTINCT g, l FROM up WHERE n > 1) k ON k.g = d.g LEFT JOIN up b ON b.g = d.g AND b.l = k.l AND b.i = xor(d.i >> k.l, 1) GROUP BY d.g, d.i),
high AS (SELECT s.g, list(CASE WHEN (s.i >> k.l) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(b.h, '') ORDER BY k.l) AS p FROM s JOIN (SELECT DISTINCT l FROM top WHERE n > 1) k ON true LEFT JOIN top b ON b.l = k.l AND b.i = xor(s.i >> k.l, 1) GROUP BY s.g),
f AS (SELECT d.*, subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(coalesce(low.p, []), coalesce(high.p, [])) AS p FROM d JOIN s ON s.g = d.g LEFT JOIN low ON low.g = d.g AND low.i = d.i LEFT JOIN high ON high.g = d.g),
o AS (SELECT *, list_reduce(list_prepend(seen, p), lambda x, y: sha256(CASE WHEN y[1] = 'L' THEN y[2:] || x ELSE x || y[2:] END)) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(p, lambda y: y[2:]), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o""",
}
