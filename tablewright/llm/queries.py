"""One registered query for each operator of this package, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table as table
from . import (
    decontaminate, licenses, line_dedup, manifest, minhash, packing, periodic_runs, quality, secrets, token_counts, toxicity, url_filter, warc,
)

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_minhash(spark: SparkSession, d: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, d, "pages"), url_filter.rules_table(spark, URL_RULES))


def op3_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(table(spark, d, "documents"))


def op4_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.benchmark_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    items = F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull()))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def word_bpe() -> str:
    """The vocabulary file, found where the task runs."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


#: Ends each document.
END_ID = 2


def op6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), word_bpe, END_ID)


def op7_warc_archive(spark: SparkSession, d: str) -> DataFrame:
    folder = warc.write_archive(table(spark, d, "pages"), scratch_path(spark, "warc"))
    return warc.record_facts(spark, folder).withColumnRenamed("row", "page_id")


#: Least score of a document that is called toxic.
TOXIC = 0.7


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    found = toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, count="n_removed")


def op10_license_scan(spark: SparkSession, d: str) -> DataFrame:
    templates = [(t, label, True) for t, label in licenses.PHRASES] + [(t, label, False) for t, label in licenses.NOTICES]
    found = licenses.scan_licenses(table(spark, d, "documents"), licenses.templates_table(spark, templates))
    base = F.filter("spans", lambda s: s["base"])
    start = lambda s: s["first_word"].cast("bigint")
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, start)).alias("first_word"),
        F.array_max(F.transform(base, start)).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.col("best").alias("score"),
    )


def _let(value, body):
    """``body`` of a value that is computed once, where columns would be computed at each use."""
    return F.transform(F.array(value), body)[0]


def _repeating(text, doc_id):
    """The texts of the contract: of a tenth of the documents, words from some place on repeat what stands there."""
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shaped(v):
        n = F.size(v["words"])
        a = v["g"] % n
        return F.struct(v["words"].alias("words"), a.cast("int").alias("a"), (1 + F.floor((n - a) / (3 + v["g"] % 8))).cast("int").alias("p"))

    def word(v):
        return lambda w, i: F.when(i < v["a"], w).otherwise(F.get(v["words"], v["a"] + (i - v["a"]) % v["p"]))

    changed = _let(F.struct(words.alias("words"), F.floor(h / 10).alias("g")), lambda v: F.when(F.size(v["words"]) > 0, F.array_join(
        _let(shaped(v), lambda v: F.transform(v["words"], word(v))), " ")))
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", _repeating(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.short")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.short")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    low = F.translate("text", url_filter.UPPER, url_filter.LOWER)
    changed = manifest.leaf_digest(*[low if f == "text" else F.col(f) for f in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = manifest.manifest(docs.withColumn("changed", F.when(hit, changed)), FIELDS, carry=["changed"])
    found = found.withColumn("folded_root", manifest.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    proof = F.sha2(manifest.siblings(F.col("proof")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Most tokens of a text within the limit.
TOKEN_LIMIT = 2048


def op13_token_counts(spark: SparkSession, d: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, d, "documents"), word_bpe, blank_apart=True)
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontaminate": op4_decontaminate,
    "op5_secret_scan": op5_secret_scan,
    "op6_packing": op6_packing,
    "op7_warc_archive": op7_warc_archive,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_manifest": op12_manifest,
    "op13_token_counts": op13_token_counts,
}


def _sql_rule(verdict: str, host: str, path: str) -> str:
    fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    return f"CASE WHEN {fits} THEN {{{{'n': {len(host + path)}, 'rule': '{host + path}', 'verdict': '{verdict}'}}}} END"


_PARSED = r"""
    SELECT page_id, url,
        CASE WHEN contains(url, '://') THEN translate(regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = f"regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+')"
_ALNUM = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

def _sql_leaf(text: str) -> str:
    fields = [f"CAST({f} AS VARCHAR)" for f in [*FIELDS[:-1], text]]
    return f"sha256({' || '.join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)})"


def _sql_tree(name: str, levels: int = 6) -> str:
    """CTEs over ``<name>_0 (part, id, p, d)``: ``<name>_tops (part, d)`` and ``<name>_proofs (part, id, d, proof)``.

    On every level a part with several nodes has its runs p // 16 hashed; a part with one node stays as it is.
    """
    steps = [f"""
        {name}_r{k} AS (SELECT part, p // 16 AS q, list(d ORDER BY p) AS ds
            FROM (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM {name}_{k}) WHERE n > 1 GROUP BY 1, 2),
        {name}_{k + 1} AS (SELECT part, q AS p, sha256(array_to_string(ds, '')) AS d FROM {name}_r{k}
            UNION ALL SELECT part, p, d FROM (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM {name}_{k}) WHERE n = 1)""" for k in range(levels)]  # fmt: skip
    proofs = f"SELECT part, id, d, p AS spot, [] :: STRUCT(l VARCHAR, r VARCHAR)[] AS proof FROM {name}_0"
    for k in range(levels):
        own = "{'l': array_to_string(ds[1:spot % 16], ''), 'r': array_to_string(ds[spot % 16 + 2:], '')}"
        proofs = f"""SELECT a.part, id, d, spot // 16 AS spot, CASE WHEN q IS NULL THEN proof ELSE list_append(proof, {own}) END AS proof
            FROM ({proofs}) a LEFT JOIN {name}_r{k} r ON a.part IS NOT DISTINCT FROM r.part AND spot // 16 = q"""
    return ",".join(steps) + f", {name}_tops AS (SELECT part, d FROM {name}_{levels}), {name}_proofs AS ({proofs})"


# CRC-32 (fixed value: its reversed polynomial) of the ASCII text of a whole number.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
_CRC = f"xor(list_reduce([4294967295] || {_CRC_BYTES}, lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1])), 4294967295)"

ORACLE = {
    "op12_manifest": f"""
        WITH leaves AS (SELECT doc_id, source, {_sql_leaf('text')} AS d, CASE WHEN {_CRC} % 5 = 0 THEN {_sql_leaf(
            "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
            FROM documents, (SELECT {_CRC_TABLE} AS crc_table)),
        s_0 AS (SELECT source AS part, {{'doc_id': doc_id, 'changed': changed}} AS id, d,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS p FROM leaves),{_sql_tree('s')},
        t_0 AS (SELECT 0 AS part, part AS id, d, row_number() OVER (ORDER BY part NULLS FIRST) - 1 AS p FROM s_tops),{_sql_tree('t')},
        found AS (SELECT s.id.doc_id AS doc_id, s.d AS leaf, t.d AS subroot, t_tops.d AS root, s.id.changed AS changed, s.proof || t.proof AS proof
            FROM s_proofs s JOIN t_proofs t ON s.part IS NOT DISTINCT FROM t.id, t_tops),
        folded AS (SELECT *, list_reduce([coalesce(changed, leaf)] || list_transform(proof, lambda x: x.l || '|' || x.r),
            lambda node, x: sha256(split_part(x, '|', 1) || node || split_part(x, '|', 2))) AS folded_root FROM found)
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda x: x.l || x.r), '')) AS proof_sha256,
            folded_root, folded_root = root AS verified
        FROM folded""",
    "op1_minhash": f"""
        WITH RECURSIVE words AS (SELECT doc_id, {_BLANK} AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5
            THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM roots LEFT JOIN sizes USING (doc_id)""",
    "op4_decontaminate": f"""
        WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        items AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
        grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
        found AS (SELECT doc_id, item_id, i, k FROM grams JOIN windows USING (k, g)),
        hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
        hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op2_url_filter": f"""
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM (
            SELECT page_id, host, path, list_max(list_filter([{', '.join(_sql_rule(*r) for r in URL_RULES)}], lambda x: x IS NOT NULL)) AS best
            FROM ({_PARSED}))""".replace("{{", "{").replace("}}", "}"),
    "op7_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        o AS (SELECT html, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY html)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
            CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN owner <> page_id THEN owner END AS refers_to
        FROM p LEFT JOIN o USING (html)""",
}
