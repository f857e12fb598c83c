"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import glossary, lint, segments, splits, terms, usage
from .sources import html

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_PAIRS = """SELECT conv_id, turn, text AS source, target FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'"""
_LINES = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS seg, source FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS source, unnest(range(len(string_split(text, chr(10))))) AS o FROM documents) WHERE trim(source) <> ''"""
_TOKENS = r"""SELECT doc_id, s, unnest(range(len(w))) AS pos, unnest(w) AS tok FROM (
  SELECT doc_id, s, regexp_extract_all(s, '\p{L}(?:[\p{L}''\-])*') AS w FROM (
    SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?…])["''”’]*\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS s FROM documents @WHERE@))"""
_TITLE = r"regexp_matches(tok, '^\p{Lu}') AND lower(substr(tok, 2)) = substr(tok, 2) AND upper(substr(tok, 2)) <> substr(tok, 2)"


@_query(f"SELECT conv_id, turn, round(length(trim(target)) / length(trim(source)), 6) AS ratio, CASE WHEN length(trim(target)) = 0 THEN 'empty' WHEN length(trim(target)) / length(trim(source)) < 0.3 THEN 'too_short' WHEN length(trim(target)) / length(trim(source)) > 3 THEN 'too_long' ELSE 'ok' END AS flag FROM ({_PAIRS})")
def length_ratio_flags(spark, sf_dir):
    s, t = F.col("source"), F.col("target")
    return lint.turn_pairs(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", lint.length_ratio(s, t).alias("ratio"), lint.length_flag(s, t).alias("flag"))


@_query(f"SELECT conv_id, turn, length(trim(source)) >= 120 AND length(trim(target)) / length(trim(source)) < 0.15 AS gated FROM ({_PAIRS})")
def en_too_short_gate(spark, sf_dir):
    return lint.turn_pairs(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", lint.hard_short(F.col("source"), F.col("target")).alias("gated"))


@_query(f"""SELECT conv_id, turn, substr(trim(source), 1, 1) IN ('"', '“', '「', '『', '«') AND NOT regexp_matches(coalesce(target, ''), '[“”「」『』《》]') AS lost FROM ({_PAIRS})""")
def quote_loss_pairs(spark, sf_dir):
    return lint.turn_pairs(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", lint.quote_loss(F.col("source"), F.col("target")).alias("lost"))


@_query(_LINES)
def segment_lines(spark, sf_dir):
    return segments.lines(_t(spark, sf_dir, "documents"), "doc_id")


@_query(f"SELECT doc_id, seg, CAST(sum(CASE WHEN length(source) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg) AS BIGINT) AS chapter FROM ({_LINES})")
def chapter_by_heading(spark, sf_dir):
    return segments.chapters(segments.lines(_t(spark, sf_dir, "documents"), "doc_id"), "doc_id", F.length("source") < 40).select("doc_id", "seg", "chapter")


@_query(f"""WITH RECURSIVE l AS (SELECT doc_id, seg, length(source) AS n FROM ({_LINES})),
p AS (SELECT doc_id, seg, n, n AS size, 0 AS pack FROM l WHERE seg = 0
  UNION ALL SELECT l.doc_id, l.seg, l.n, CASE WHEN p.size > 0 AND p.size + l.n > 1800 THEN l.n ELSE p.size + l.n END, CASE WHEN p.size > 0 AND p.size + l.n > 1800 THEN p.pack + 1 ELSE p.pack END
  FROM p JOIN l ON l.doc_id = p.doc_id AND l.seg = p.seg + 1)
SELECT doc_id, CAST(pack AS INTEGER) AS pack, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_chars FROM p GROUP BY doc_id, pack""")
def batch_pack_1800(spark, sf_dir):
    return segments.packs(_t(spark, sf_dir, "documents"), "doc_id")


@_query("""SELECT conv_id, island, flag, min(turn) AS first_pos, max(turn) AS last_pos FROM (
  SELECT conv_id, turn, flag, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM (
    SELECT conv_id, turn, role = 'assistant' AS flag, CASE WHEN lag(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) <> (role = 'assistant') THEN 1 ELSE 0 END AS new FROM conversations)) GROUP BY conv_id, island, flag""")
def resume_islands(spark, sf_dir):
    return segments.islands(_t(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant")


@_query(f"SELECT tok, count(*) AS token_total, count(DISTINCT doc_id) AS n_docs, bool_or(pos <> 0) AS ever_inside FROM ({_TOKENS.replace('@WHERE@', '')}) WHERE {_TITLE} GROUP BY tok")
def title_case_tokens(spark, sf_dir):
    return terms.title_case_tokens(_t(spark, sf_dir, "documents"), "doc_id")


_STOP = ", ".join(f"'{w}'" for w in terms.STOP)
_JOIN = ", ".join(f"'{w}'" for w in terms.CONNECTORS)
_ACRO = r"length(tok) >= 2 AND upper(tok) = tok AND lower(tok) <> tok AND NOT regexp_full_match(tok, '[IVXLCDM]+')"


def _mine(where: str) -> str:
    sentences = _TOKENS.replace("@WHERE@", where).replace("SELECT doc_id, s, unnest(range(len(w))) AS pos", "SELECT doc_id, n, unnest(range(len(w))) AS pos").replace("SELECT doc_id, s, regexp_extract_all", "SELECT doc_id, row_number() OVER () AS n, regexp_extract_all")
    return f"""SELECT surface, n, n_docs, first_doc FROM (WITH t AS ({sentences}),
f AS (SELECT *, {_TITLE} AS title, {_ACRO} AS caps, lower(tok) IN ({_STOP}) AS stop, lower(tok) IN ({_JOIN}) AS small FROM t),
g AS (SELECT *, title OR (small AND coalesce(lag(title) OVER w, false) AND coalesce(lead(title) OVER w, false)) AS inside FROM f WINDOW w AS (PARTITION BY n ORDER BY pos)),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY n ORDER BY pos) AS run FROM g WHERE inside),
e AS (SELECT *, min(CASE WHEN NOT stop THEN pos END) OVER w AS a, max(CASE WHEN NOT stop THEN pos END) OVER w AS z FROM r WINDOW w AS (PARTITION BY n, run)),
c AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY pos) AS surface, CASE WHEN count(*) > 1 THEN 'run' ELSE 'word' END AS kind FROM e WHERE pos BETWEEN a AND z GROUP BY doc_id, n, run
  UNION ALL SELECT doc_id, tok, 'caps' FROM f WHERE caps AND NOT stop),
k AS (SELECT tok FROM f WHERE title GROUP BY tok HAVING count(*) >= 2 AND bool_or(pos <> 0))
SELECT surface, kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM c WHERE kind <> 'word' OR surface IN (SELECT tok FROM k) GROUP BY surface, kind
HAVING kind = 'run' OR count(*) >= 2)"""


@_query(_mine("WHERE lang = 'en'"))
def mine_candidates_en(spark, sf_dir):
    return terms.candidates(_t(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@_query(f"""WITH u AS (SELECT 0 AS ch, surface, n FROM ({_mine("WHERE lang = 'en'")}) UNION ALL SELECT 1, surface, n FROM ({_mine("WHERE lang = 'de'")}))
SELECT lower(surface) AS key, max(n) AS n, arg_min(surface, CAST(ch AS VARCHAR) || surface) AS surface FROM u GROUP BY 1""")
def merge_candidate_channels(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return terms.merge_channels(terms.candidates(d.where("lang = 'en'"), "doc_id"), terms.candidates(d.where("lang = 'de'"), "doc_id"))


@_query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def terms_in_text(spark, sf_dir):
    return terms.contained(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), ["doc_id"], "text", ["item_id"], "text")


_WORD_OF = r"regexp_extract(text, '^[^ ]*?([A-Za-z]+)', 1)"


@_query(rf"""WITH t AS (SELECT DISTINCT {_WORD_OF} AS w FROM benchmark), p AS (SELECT DISTINCT doc_id, text AS source, lower(text) AS target FROM documents)
SELECT DISTINCT doc_id, w AS term_source, w AS term_target FROM p JOIN t ON w <> '' AND contains(source, w) AND regexp_matches(source, '(^|[^\p{{L}}\p{{N}}_])' || w || '($|[^\p{{L}}\p{{N}}_])') WHERE NOT contains(coalesce(target, ''), w)""")
def term_miss(spark, sf_dir):
    """Terms: the first words of the benchmark, locked as they are; targets: the documents in lower case."""
    asked = _t(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "^[^ ]*?([A-Za-z]+)", 1).alias("source"))
    pairs = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"), F.lower("text").alias("target"))
    return lint.missed_terms(pairs, ["doc_id"], asked.withColumn("target", F.col("source")))


@_query(r"""SELECT k.doc_id, m.first_id FROM (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS key FROM documents) k
JOIN (SELECT lower(regexp_replace(text, '\s+', '', 'g')) AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1) m ON k.key = m.key AND n > 1 WHERE k.doc_id <> m.first_id AND k.key <> ''""")
def untranslated_pairs(spark, sf_dir):
    """Documents equal to an earlier one but for case and white space; blank ones say nothing."""
    d = _t(spark, sf_dir, "documents").select("doc_id", tx.compare_key(F.col("text")).alias("k")).where("k <> ''").select("doc_id", F.sha2("k", 256).alias("key"))
    first = d.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(first, "key").where("doc_id <> first_id").select("doc_id", "first_id")


@_query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS num FROM documents")
def number_tokens(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)*"), 0)).alias("num"))


@_query(r"SELECT doc_id, round((length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) / length(text), 6) AS ratio FROM documents WHERE length(text) > 0")
def letter_ratio(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.round(tx.share_of(F.col("text"), "[A-Za-z]"), 6).alias("ratio"))


_ALTERNATE = "array_to_string(list_transform(string_split({t}, {m}), lambda x, i: CASE WHEN i = 1 THEN x WHEN i % 2 = 0 THEN '{a}' || x ELSE '{b}' || x END), '')"
_HAN_SIDE = "[一-鿿぀-ヿ＀-￯“”‘’（）《》【】、，。！？：；…—]"


@_query(rf"""WITH q AS (SELECT doc_id, translate(text, '「」『』', '“”‘’') AS t FROM documents),
d AS (SELECT doc_id, {_ALTERNATE.format(t='t', m="chr(34)", a='“', b='”')} AS t FROM q),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([A-Za-z])''([A-Za-z])', '\1’\2', 'g'), '([A-Za-z])''([A-Za-z])', '\1’\2', 'g') AS t FROM d),
s AS (SELECT doc_id, {_ALTERNATE.format(t='t', m="chr(39)", a='‘', b='’')} AS t FROM a),
e AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '。{{3,}}|・{{2,}}|[.]{{3,}}', '…', 'g'), '…+', '……', 'g'), '-{{2,}}', '—', 'g'), '—+', '——', 'g') AS t FROM s),
c AS (SELECT doc_id, string_split(t, '') AS cs FROM e),
w AS (SELECT doc_id, array_to_string(list_transform(cs, lambda c, i: CASE WHEN c IN (',', '.', '!', '?', ':', ';') AND (regexp_matches(coalesce(CASE WHEN i > 1 THEN cs[i - 1] END, ''), '{_HAN_SIDE}') OR regexp_matches(coalesce(cs[i + 1], ''), '{_HAN_SIDE}')) THEN translate(c, ',.!?:;', '，。！？：；') ELSE c END), '') AS t FROM c)
SELECT doc_id, regexp_replace(t, '([，。！？：；、”’》】])\s+', '\1', 'g') AS text FROM w""")
def normalize_punct(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.normalize_zh(F.col("text")).alias("text"))


_MARKS = "章节部卷回集"
_HEADING = f"'第' || CASE WHEN doc_id % 3 = 0 THEN translate(CAST(doc_id * 7 AS VARCHAR), '0123456789', '０１２３４５６７８９') ELSE CAST(doc_id * 7 AS VARCHAR) END || substr('{_MARKS}', CAST(doc_id % 6 + 1 AS INTEGER), 1) || ' ' || source"
_HAN_DIGIT = "substr('零一二三四五六七八九', CAST({n} AS INTEGER) + 1, 1)"


@_query(f"""WITH h AS (SELECT doc_id, doc_id * 7 AS n, {_HEADING} AS heading FROM documents),
d AS (SELECT *, n // 1000 AS th, n // 100 % 10 AS hu, n // 10 % 10 AS te, n % 10 AS u FROM h),
w AS (SELECT *, CASE WHEN th > 0 THEN {_HAN_DIGIT.format(n='th')} || '千' ELSE '' END || CASE WHEN hu > 0 THEN {_HAN_DIGIT.format(n='hu')} || '百' WHEN th > 0 AND n % 100 > 0 THEN '零' ELSE '' END
 || CASE WHEN te > 0 THEN CASE WHEN n BETWEEN 10 AND 19 THEN '' ELSE {_HAN_DIGIT.format(n='te')} END || '十' WHEN hu > 0 AND u > 0 THEN '零' ELSE '' END || CASE WHEN u > 0 THEN {_HAN_DIGIT.format(n='u')} ELSE '' END AS han FROM d WHERE n < 10000)
SELECT h.doc_id, h.heading, CASE WHEN h.n BETWEEN 1 AND 9999 AND h.doc_id % 6 < 5 THEN '第' || han || substr('{_MARKS}', CAST(h.doc_id % 6 + 1 AS INTEGER), 1) || ' ' || source ELSE h.heading END AS numbered
FROM h JOIN documents d ON h.doc_id = d.doc_id LEFT JOIN w ON h.doc_id = w.doc_id""")
def heading_numbering(spark, sf_dir):
    n = (F.col("doc_id") * 7).cast("string")
    number = F.when(F.col("doc_id") % 3 == 0, F.translate(n, "0123456789", "０１２３４５６７８９")).otherwise(n)
    heading = F.concat(F.lit("第"), number, F.substring(F.lit(_MARKS), F.col("doc_id") % 6 + 1, F.lit(1)), F.lit(" "), "source")
    d = _t(spark, sf_dir, "documents").select("doc_id", heading.alias("heading"))
    return d.select("doc_id", "heading", tx.number_heading(F.col("heading")).alias("numbered"))


_CONF = "CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' ELSE 'high' END"


_FOLD = f"""e AS (SELECT CAST(user_id AS VARCHAR) AS source, event_id AS seq, event_type AS target, {_CONF} AS confidence, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END + CASE WHEN event_id % 50 = 7 THEN 10 ELSE 0 END AS rk, event_id % 50 = 7 AS locked, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT source, seq, target, confidence, rk, locked, 'ok' AS status, 'inserted' AS result, CAST(NULL AS VARCHAR) AS old_target, target AS new_target, k FROM e WHERE k = 1
 UNION ALL SELECT f.source, e.seq, CASE WHEN wins THEN e.target ELSE f.target END, CASE WHEN wins THEN e.confidence ELSE f.confidence END, CASE WHEN wins THEN e.rk % 10 + CASE WHEN f.locked THEN 10 ELSE 0 END ELSE f.rk END, f.locked,
  CASE WHEN e.target <> f.target THEN 'conflict' ELSE f.status END, CASE WHEN e.target = f.target THEN 'unchanged' WHEN wins THEN 'updated' ELSE 'conflict' END, f.target, e.target, e.k
  FROM (SELECT f.*, e.target <> f.target AND e.rk > f.rk AS wins FROM f JOIN e ON e.source = f.source AND e.k = f.k + 1) f JOIN e ON e.source = f.source AND e.k = f.k + 1)"""


def _proposals(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("seq"), F.col("event_type").alias("target"), F.expr(_CONF).alias("confidence"), (F.col("event_id") % 50 == 7).alias("locked")
    )


@_query(f"""WITH RECURSIVE {_FOLD} SELECT source, target, confidence, locked, status, CAST(nc AS BIGINT) AS n_conflicts, CAST(nu AS BIGINT) AS n_updates FROM (
  SELECT *, max(k) OVER w AS mk, count(*) FILTER (WHERE result IN ('conflict', 'updated')) OVER w AS nc, count(*) FILTER (WHERE result = 'updated') OVER w AS nu FROM f WINDOW w AS (PARTITION BY source)) WHERE k = mk""")
def glossary_upsert(spark, sf_dir):
    steps = glossary.fold(_proposals(spark, sf_dir))
    counts = steps.groupBy("source").agg(F.count_if(F.col("result").isin("conflict", "updated")).alias("n_conflicts"), F.count_if(F.col("result") == "updated").alias("n_updates"))
    return glossary.terms(steps).join(counts, "source").select("source", "target", "confidence", "locked", "status", "n_conflicts", "n_updates")


@_query(f"WITH RECURSIVE {_FOLD} SELECT source, seq, old_target AS existing_target, new_target AS proposed_target FROM f WHERE result IN ('conflict', 'updated')")
def glossary_conflicts(spark, sf_dir):
    return glossary.open_conflicts(glossary.fold(_proposals(spark, sf_dir))).select("source", "seq", "existing_target", "proposed_target")


@_query(f"WITH RECURSIVE {_FOLD} SELECT result, count(*) AS n, count(*) FILTER (WHERE result IN ('inserted', 'updated')) AS n_changed FROM f GROUP BY result")
def glossary_results(spark, sf_dir):
    return glossary.results(glossary.fold(_proposals(spark, sf_dir)))


@_query(f"WITH RECURSIVE {_FOLD} SELECT source, target FROM (SELECT *, max(k) OVER (PARTITION BY source) AS mk FROM f) WHERE k = mk AND (confidence = 'low' OR status = 'conflict')")
def low_confidence_terms(spark, sf_dir):
    return glossary.low_confidence(glossary.terms(glossary.fold(_proposals(spark, sf_dir)))).select("source", "target")


@_query("SELECT sha256(trim(text)) AS source_hash, max(doc_id) AS seq, arg_max(source, doc_id) AS target FROM documents GROUP BY 1")
def tm_last_write(spark, sf_dir):
    return glossary.memory(_t(spark, sf_dir, "documents"), "text", "source", "doc_id")


@_query("SELECT event_type AS tier, user_id % 7 AS stage, count(*) AS calls, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 7), ())")
def usage_grouping_sets(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("st"), F.round("value").cast("bigint").alias("v"))
    return usage.grouping(e, "event_type", "st", "v")


def _slices(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    one = lambda c: e.where(c).groupBy("user_id").agg(F.count("*").alias("n"))
    return one("event_id % 3 = 0"), one("event_id % 3 <> 0")


_SLICES = "WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1) "


@_query(_SLICES + "SELECT coalesce(a.user_id, b.user_id) AS user_id, greatest(0, coalesce(b.n, 0) - coalesce(a.n, 0)) AS grown FROM a FULL JOIN b ON a.user_id = b.user_id WHERE greatest(0, coalesce(b.n, 0) - coalesce(a.n, 0)) > 0")
def usage_delta(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return usage.delta(b, a, "user_id", "n")


@_query(_SLICES + "SELECT user_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY user_id")
def usage_merge(spark, sf_dir):
    return usage.merged(*_slices(spark, sf_dir), "user_id", "n")


@_query("SELECT d.source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, count(*) FILTER (WHERE l.quality = 0) AS n_low, count(*) FILTER (WHERE l.toxic = 1) AS n_toxic, count(*) FILTER (WHERE trim(d.text) = '') AS n_empty FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def report_rollup(spark, sf_dir):
    j = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "lid"), F.col("doc_id") == F.col("lid"), "left")
    return j.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("lid").alias("n_labelled"), F.count_if(F.col("quality") == 0).alias("n_low"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(tx.is_blank(F.col("text"))).alias("n_empty"))


@_query("SELECT source, median(n_chars) AS median_chars FROM documents GROUP BY source")
def median_slice(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.median("n_chars").alias("median_chars"))


@_query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedupe_keep_first(spark, sf_dir):
    return segments.keep(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@_query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedupe_keep_last(spark, sf_dir):
    return segments.keep(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", last=True)


@_query("SELECT user_id, event_id, used FROM (SELECT user_id, event_id, value > 50 AS ok, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS used FROM events) WHERE ok AND used <= 3")
def quota_running(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 50).alias("ok"))
    return segments.running_quota(e, "user_id", "event_id", F.col("ok"), 3).select("user_id", "event_id", "used")


@_query("SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations WHERE trim(text) <> ''")
def rolling_context(spark, sf_dir):
    return segments.rolling_context(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@_query("SELECT conv_id, turn, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM conversations")
def neighbour_context(spark, sf_dir):
    return segments.neighbours(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@_query("""SELECT conv_id, substr(string_agg(text, '……' ORDER BY turn), 1, 600) AS digest FROM (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations) WHERE a <= 3 OR z <= 2 GROUP BY conv_id""")
def head_tail_digest(spark, sf_dir):
    return segments.head_tail(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@_query("SELECT user_id, string_agg(event_type, '；' ORDER BY event_id, event_type) AS feedback FROM events WHERE value > 80 GROUP BY user_id")
def issue_feedback(spark, sf_dir):
    return lint.feedback(_t(spark, sf_dir, "events").where("value > 80"), ["user_id"], "event_id", "event_type")


@_query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS hits, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS false_positives, count(*) FILTER (WHERE quality = 1) AS positives, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / count(*) FILTER (WHERE quality = 1), 6) AS recall FROM labels")
def ab_verdict_metrics(spark, sf_dir):
    return usage.verdict(_t(spark, sf_dir, "labels"), "quality", "toxic")


@_query()
def html_blocks(spark, sf_dir):
    return html.html_blocks(_t(spark, sf_dir, "pages"))


@_query()
def long_segment_split(spark, sf_dir):
    return splits.split_long(segments.lines(_t(spark, sf_dir, "documents"), "doc_id"), "source", 1200)


def queries() -> dict[str, Query]:
    from . import catalog_books

    return _Q | catalog_books.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalog_books

    return _SQL | catalog_books.SQL
