"""One query per operator over its whole table, and the DuckDB SQL of those that SQL can express."""
from pyspark.sql import functions as F

from curbloop.llm import bestfit, divergence, language, mixing, neardup, neighbours, packing, quality, secret_scan, sharding, tokenstore, warc, whitening
from curbloop.operators.scratch import new_path, stage


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(F.col("doc_id").isNotNull() & ~language.held_out()))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark, sf_dir):
    out = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_packing(spark, sf_dir):
    pieces = stage(packing.cut(_table(spark, sf_dir, "documents")), "pieces")
    digests = pieces.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_warc(spark, sf_dir):
    folder = new_path(spark, "warc")
    records = warc.read_archive(warc.write_archive(_table(spark, sf_dir, "pages"), folder), folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + sharding.ROW_COST).cast("long").alias("size"),
                                                     F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    out = sharding.shard(stage(rows, "sizes"), size=F.col("size"), group=F.col("text_hash"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_neighbours(spark, sf_dir):
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.expr("id % 50 = 0"))


#: Target weights of the mix: shares within the parent. A level that is null stands above.
WEIGHTS = [("web", None, None, 5), ("books", None, None, 3), ("code", None, None, 1), ("forum", None, None, 2),
           ("web", "en", None, 4), ("web", "de", None, 2), ("books", "fr", None, 3), ("books", "en", None, 2), ("forum", "es", None, 6),
           ("web", "en", "src0", 2), ("web", "en", "src4", 5), ("code", "en", "src2", 3)]
DOMAINS = ["web", "books", "code", "forum"]
SEED, EPOCHS = 7, 4


def domain_of(source="source"):
    """A source's domain by the number in its name."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "[0-9]{1,9}", 0)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.when(number == "", "other").otherwise(F.get(names, F.nullif(number, F.lit("")).cast("int") % len(DOMAINS)))


def weights(spark):
    return spark.createDataFrame(WEIGHTS, "domain string, lang string, source string, weight long")


def op7_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "text", "lang", "source"), weights(spark), domain_of(), max_epochs=EPOCHS, seed=SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op8_token_store(spark, sf_dir):
    folder = new_path(spark, "token-store")
    out = tokenstore.read_store(tokenstore.write_store(_table(spark, sf_dir, "documents"), folder), folder)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_near_dedup(spark, sf_dir):
    return neardup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op10_secrets(spark, sf_dir):
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"))


def op11_best_fit(spark, sf_dir):
    pieces = stage(bestfit.cut(_table(spark, sf_dir, "documents")), "pieces")
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return bestfit.pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS words FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
by_line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
                   count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]')) AS n_bullets,
                   count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipses
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
spots AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS pos FROM d WHERE len(words) > 8),
windows AS (SELECT r, pos, count(*) OVER (PARTITION BY r, array_to_string(words[pos:pos + 7], ' ')) AS n FROM spots),
covered AS (SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM windows, range(0, 8) AS x(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets,
             coalesce(n_ellipses, 0) AS n_ellipses, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
             length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
             len(list_filter(words, lambda w: lower(w) IN ({", ".join(f"'{w}'" for w in quality.STOP_WORDS)}))) AS n_stop
      FROM d LEFT JOIN by_line USING (r) LEFT JOIN covered USING (r)),
k AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS w, greatest(n_lines, 1) AS l FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 1000000 AND word_chars / w BETWEEN 2.5 AND 12 AND n_symbols / w <= 0.25 AND n_stop / w >= 0.03
       AND n_upper / greatest(n_letters, 1) <= 0.5 AND n_letters / greatest(word_chars, 1) >= 0.6 AND n_dup_lines / l <= 0.4
       AND n_repeat_words / w <= 0.3 AND n_bullets / l <= 0.9 AND n_ellipses / l <= 0.3 AS kept
FROM k"""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', 1 + CAST(
           (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g"""


def _mix_sql() -> str:
    """The water filling of each level in turn, then the documents in seeded order."""
    rows = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in w) + ")" for w in WEIGHTS)
    names = ", ".join(repr(d) for d in DOMAINS)
    sql = rf"""
WITH w(domain, lang, source, weight) AS (VALUES {rows}),
n AS (SELECT *, regexp_extract(coalesce(source, ''), '[0-9]{{1,9}}') AS number, len({WORDS}) AS tokens FROM documents),
d AS (SELECT doc_id, lang, source, tokens, CASE WHEN number = '' THEN 'other' ELSE list_extract([{names}], CAST(number AS INT) % {len(DOMAINS)} + 1) END AS domain
      FROM n),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {EPOCHS} AS cap FROM d GROUP BY ALL),
b0 AS (SELECT least((SELECT sum(tokens) FROM leaf), sum(cap))::BIGINT AS budget FROM leaf WHERE tokens > 0)"""
    for depth, level in enumerate(mixing.LEVELS, 1):
        keys, above = mixing.LEVELS[:depth], mixing.LEVELS[:depth - 1]
        same = " AND ".join([f"c.{k} IS NOT DISTINCT FROM w.{k}" for k in keys] + [f"w.{k} IS NULL" for k in mixing.LEVELS[depth:]] + [f"w.{level} IS NOT NULL"])
        joined = " AND ".join(f"c.{k} IS NOT DISTINCT FROM p.{k}" for k in above) or "true"
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        order = f"ORDER BY cap / weight, {', '.join(keys)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        sql += f""",
c{depth} AS (SELECT {', '.join(keys)}, sum(cap)::BIGINT AS cap FROM leaf WHERE tokens > 0 GROUP BY ALL),
x{depth} AS (SELECT c.*, coalesce(w.weight, 1) AS weight, p.budget FROM c{depth} c LEFT JOIN w ON {same} JOIN b{depth - 1} p ON {joined}),
f{depth} AS (SELECT *, coalesce(sum(cap) OVER ({part} {order}), 0)::BIGINT AS filled,
             (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER ({part} {order}), 0))::BIGINT AS weight_left FROM x{depth}),
r{depth} AS (SELECT *, max(CASE WHEN (budget - filled) * weight <= cap * weight_left
             THEN {{'r': (budget - filled) / weight_left, 'n': budget - filled, 'd': weight_left}} END) OVER ({part}) AS rate FROM f{depth}),
b{depth} AS (SELECT {', '.join(keys)}, greatest(0, CASE WHEN rate IS NULL THEN cap ELSE least(cap, rate.n * weight // rate.d) END)::BIGINT AS budget FROM r{depth})"""
    match = " AND ".join(f"{{0}}.{k} IS NOT DISTINCT FROM {{1}}.{k}" for k in mixing.LEVELS)
    return sql + f""",
asked AS (SELECT leaf.*, CASE WHEN tokens > 0 THEN coalesce(budget, 0) // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN coalesce(budget, 0) % tokens ELSE 0 END AS rest
          FROM leaf LEFT JOIN b3 ON {match.format('leaf', 'b3')}),
o AS (SELECT d.*, whole, rest, sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source
             ORDER BY md5(concat_ws(':', '{SEED}', whole, coalesce(doc_id::VARCHAR, ''))) ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN asked ON {match.format('d', 'asked')}),
k AS (SELECT *, whole + CASE WHEN tokens > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, domain, lang, source, tokens, unnest(range(0, copies)) AS epoch FROM k WHERE copies > 0"""


DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN size USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v)::HUGEINT AS p,
             1 + ({divergence.SCALE}::HUGEINT * (kept.n + 1)) // (size.total + size.v)::HUGEINT AS q
      FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
          UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
         UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}"""

QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_packing, op4_warc, op5_sharding, op6_neighbours, op7_mixing,
                                   op8_token_store, op9_near_dedup, op10_secrets, op11_best_fit, op12_whitening, op13_source_divergence)}
SQL = {"op2_quality_rules": QUALITY_SQL, "op4_warc": WARC_SQL, "op7_mixing": _mix_sql(), "op13_source_divergence": DIVERGENCE_SQL}
