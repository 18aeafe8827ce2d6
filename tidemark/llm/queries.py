"""Registered queries ``opN_<name>``: thin, each through its operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, exact, html, minhash, packing, perplexity, pieces, repair, rules, search, substring, suffix
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


#: The contract's conversation that speaks in control strings.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

OP4_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
),
f AS (SELECT *, '<|' || replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '|', '\\p') || '|>' || replace(replace(text, '\\', '\\b'), '<', '\\l') || '<|end|>' AS turn_text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
x AS (SELECT conv_id, i, n, role, string_agg(turn_text, '') OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS whole FROM f),
e AS (SELECT conv_id, count(*) AS n_examples, sum(length(whole))::BIGINT AS examples_chars, sha256(string_agg(sha256(whole), '' ORDER BY i)) AS examples_sha256 FROM x WHERE role = 'assistant' OR i = n GROUP BY conv_id),
t AS (
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(11 + length(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '|', '\\p')) + length(replace(replace(text, '\\', '\\b'), '<', '\\l')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id)
SELECT t.*, n_examples, examples_chars, examples_sha256 FROM t JOIN e ON e.conv_id IS NOT DISTINCT FROM t.conv_id
"""


@query("op4_chat_formatting", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = given.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.expand(chat.format_conversations(rows)))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""


@query("op5_exact_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(table(spark, sf_dir, "documents"))


def _stop_sql() -> str:
    lists = " ".join(f"WHEN '{k}' THEN {v.split()!r}" for k, v in rules.STOP_WORDS.items())
    return f"CASE lang {lists} ELSE {rules.ALL_STOP_WORDS!r} END"


def _rule_sql(r: rules.Rule) -> str:
    part, whole = (r.part, "1") if r.whole is None else (f"100 * {r.part}", r.whole)
    tests = [f"{part} >= {r.low} * {whole}"] * (r.low is not None) + [f"{part} <= {r.high} * {whole}"] * (r.high is not None)
    return f"(n_words < {r.least} OR ({' AND '.join(tests)}))"


OP7_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: length(x) > 30)) AS n_long_words,
    length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters,
    len(regexp_extract_all(t, '!!')) AS n_shouts,
    len(list_filter(w, lambda x: list_contains({_stop_sql()}, lower(x)))) AS n_stop,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_twice
  FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_rule_sql(r) for r in rules.THRESHOLDS)} AS kept
FROM v
"""


@query("op7_quality_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents")).select(*OP7_COLUMNS)


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text")))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(35) r(k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word LEFT JOIN gone USING (doc_id, p)
  WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op3_substring_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
win AS (SELECT doc_id, i, substr(t, 2 * i + 1, 100) AS s FROM (SELECT doc_id, t, unnest(range(0, length(t) // 2 - 49)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(50) r(k)),
run AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gone),
n AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT g) AS n_spans FROM run GROUP BY doc_id),
byte AS (SELECT doc_id, i AS p, substr(t, 2 * i + 1, 2) AS x FROM (SELECT doc_id, t, unnest(range(0, length(t) // 2)) AS i FROM d)),
kept AS (SELECT byte.doc_id, string_agg(x, '' ORDER BY p) AS t FROM byte LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY byte.doc_id)
SELECT d.doc_id, (length(d.t) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.t, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op2_suffix_array_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


@query("op1_minhash_near_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_of(table(spark, sf_dir, "documents"), share=85)


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the digest of the text decoded from them."""
    out = pieces.decode_documents(pieces.encode_documents(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_chars", F.round("perplexity", 4).alias("perplexity"), "kept")


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages, table(spark, sf_dir, "documents")))


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL cannot encode; tests compare with the tiktoken library."""
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH RECURSIVE g AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
r AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(s) + 1),
    lambda i: [ascii(substr(s, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT) % 20 AS k FROM g),
d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
p AS (
  SELECT *, left(role, 1) AS h, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM o),
f AS (
  SELECT *, blank OR again AS gone, (NOT blank AND NOT again AND cut)::BIGINT AS t,
    lag(h) OVER (PARTITION BY conv_id ORDER BY i) || h NOT IN ('su', 'ua', 'au') AS illegal FROM p),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank,
    count(*) FILTER (again AND NOT blank)::BIGINT AS duplicate, sum(t)::BIGINT AS truncated, count(*) FILTER (illegal)::BIGINT AS illegal FROM f GROUP BY conv_id),
b AS (
  SELECT conv_id, n + 1 AS i, [0, 4, 2, 0]::BIGINT[] AS c FROM n
  UNION ALL
  SELECT conv_id, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])]
  FROM (
    SELECT f.conv_id, f.i, CASE WHEN gone THEN [3 + c[1], 3 + c[2], 3 + c[3], 3 + c[4]] ELSE [
        least(3 + c[1], 2 + t + c[3], CASE h WHEN 's' THEN t + c[2] WHEN 'u' THEN t + c[3] END),
        least(3 + c[2], 2 + t + c[3], CASE h WHEN 'u' THEN t + c[3] END),
        least(3 + c[3], 2 + t + c[4], CASE h WHEN 'a' THEN t + c[4] END),
        least(3 + c[4], 2 + t + c[3], CASE h WHEN 'u' THEN t + c[3] END)] END AS w
    FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)),
way AS (
  SELECT conv_id, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS made, false AS done FROM n
  UNION ALL
  SELECT conv_id, CASE e WHEN 'I' THEN i WHEN '' THEN i ELSE i + 1 END,
    CASE WHEN e IN ('D', '') THEN s WHEN e = 'K' AND h = 's' THEN 2 WHEN s = 3 THEN 4 ELSE 3 END, audit || e,
    CASE WHEN e IN ('D', '') THEN made WHEN e = 'K' THEN list_append(made, role || ':' || text)
      ELSE list_append(made, CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN text ELSE '' END) END, e = ''
  FROM (
    SELECT way.*, f.h, f.role, f.text, CASE
      WHEN f.i IS NULL THEN CASE WHEN s IN (2, 3) THEN 'I' ELSE '' END
      WHEN 3 + after.c[s] = b.c[s] THEN 'D' WHEN 2 + b.c[CASE s WHEN 3 THEN 4 ELSE 3 END] = b.c[s] THEN 'I'
      WHEN NOT gone AND (h = 's' AND s = 1 AND t + after.c[2] = b.c[s] OR h = 'u' AND s <> 3 AND t + after.c[3] = b.c[s] OR h = 'a' AND s = 3 AND t + after.c[4] = b.c[s]) THEN 'K'
      ELSE 'R' END AS e
    FROM way JOIN b ON b.conv_id IS NOT DISTINCT FROM way.conv_id AND b.i = way.i
    LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM way.conv_id AND f.i = way.i
    LEFT JOIN b AS after ON after.conv_id IS NOT DISTINCT FROM way.conv_id AND after.i = way.i + 1
    WHERE NOT way.done))
SELECT a.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
  coalesce(n.illegal, 0) AS illegal, coalesce(b.c[1], 0) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 1 LEFT JOIN way ON way.conv_id IS NOT DISTINCT FROM a.conv_id AND way.done
"""


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by a checksum of conversation and turn; NULL is one blank."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn"))) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = rows.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), k.alias("k")).filter("k != 0")
    d = d.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return d.drop("col")


@query("op12_conversation_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which the damage leaves no row have zeros."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.totals(repair.repair(damaged(given))).withColumnRenamed("conv_id", "_id")
    every = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, every["conv_id"].eqNullSafe(found["_id"]), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


OP11_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{search.OUTSIDE}]+')"
OP11_SQL = f"""
WITH t AS (SELECT doc_id, d, term, count(*) AS tf FROM (SELECT doc_id, d, unnest({OP11_TERMS}) AS term FROM (SELECT *, row_number() OVER () AS d FROM documents)) GROUP BY ALL),
n AS (SELECT d, sum(tf)::BIGINT AS n FROM t GROUP BY d),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
m AS (SELECT d, 75 + (25 * n * docs) // words AS m FROM n, a),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, a GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({OP11_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (d) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
