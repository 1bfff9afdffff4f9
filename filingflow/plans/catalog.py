"""The registered queries of the filing operators and the SQL that each must agree with.

There are no submissions or model answers among the test tables, so such inputs are built inside a query from whole tables,
in the same way on both sides; the branch that a row tests follows from its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Batch, Block, Config, Model
from ..functions import text as T
from ..operators import cache as C
from ..operators import html_units as H
from ..operators import ladder as L
from ..operators import planning as P
from ..operators import report as R
from ..operators import responses as V
from ..operators import submission as S
from ..operators.provider import KeyedProvider, usage_totals
from ..session import ship
from ..sources.files import empty_files
from . import translate as W
from .blocks import next_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space and digits of the SQL side, which has ASCII classes only.
_WS, _NS = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]", r"[^\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]"


def _norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _numbers(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '\p{{Nd}}[\p{{Nd}},]*(?:\.\p{{Nd}}+)?'), lambda x: replace(x, ',', ''))"


def _refused(x: str) -> str:
    return " OR ".join(f"regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in T.REFUSALS)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: str, *choices: str | Column) -> Column:
    """The choice by a key's remainder."""
    n, out = F.pmod(F.col(key), F.lit(len(choices))), None
    for k, c in enumerate(choices):
        c = F.lit(c) if isinstance(c, str) else c
        out = F.when(n == k, c) if out is None else out.when(n == k, c)
    return out


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as units."""
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    return lines.select(
        "doc_id", (F.col("pos") + 1).alias("ordinal"), F.concat(F.lit("u_"), F.lpad((F.col("pos") + 1).cast("string"), 4, "0")).alias("unit_id"),
        F.col("line").alias("text"), F.col("line").alias("source_text"), F.array().cast("array<struct<name:string,html:string>>").alias("placeholders"),
    )


_UNITS = """
u AS (
  SELECT doc_id, CAST(i AS INTEGER) AS ordinal, 'u_' || lpad(CAST(i AS VARCHAR), 4, '0') AS unit_id, line AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line, ' ') <> ''
)"""


# --- text -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_norm('text')} AS normal FROM documents")
def normalize_spaces(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.normalize_spaces(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE substr(t, 1, 157) || '...' END AS preview FROM (SELECT doc_id, {_norm('text')} AS t FROM documents)")
def clip_preview(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text")).alias("preview"))


@query(r"""
SELECT doc_id, regexp_replace(CASE doc_id % 3 WHEN 0 THEN '<PH_0>' || text || '</PH_0>' WHEN 1 THEN text || '<PH_12></PH_12>' ELSE '<PH_>' || text END, '</?PH_[0-9]+>', '', 'g') AS plain
FROM documents""")
def strip_placeholders(spark, sf_dir):
    marked = _pick("doc_id", F.concat(F.lit("<PH_0>"), "text", F.lit("</PH_0>")), F.concat("text", F.lit("<PH_12></PH_12>")), F.concat(F.lit("<PH_>"), "text"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.strip_placeholders(marked).alias("plain"))


@query(rf"""
WITH w AS (SELECT doc_id, {_norm("unnest(string_split(text, ' '))")} AS t FROM documents)
SELECT doc_id, count(*) AS n, CAST(count(*) FILTER (WHERE t = '' OR lower(t) IN {T.PROTECTED_TERMS} OR regexp_full_match(t, '[\p{{Nd}}\s\p{{Z}},.$()%/\-–—]+') OR regexp_full_match(t, '[A-Z]{{1,6}}')
  OR regexp_full_match(t, '[A-Z]{{1,4}}-?\p{{Nd}}{{1,4}}') OR regexp_full_match(t, '[Ff]-?\p{{Nd}}+') OR regexp_full_match(t, 'https?://{_NS}+|www\.{_NS}+') OR regexp_full_match(t, '[^@ ]+@[^@ ]+\.[^@ ]+')
  OR NOT regexp_matches(t, '[A-Za-z]')) AS BIGINT) AS low
FROM w GROUP BY doc_id""")
def low_value_filter(spark, sf_dir):
    words = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("t"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_low_value(F.col("t"))).alias("low"))


@query("SELECT doc_id, CAST(greatest(1, (length(text) + 1) // 2) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, array_to_string({_numbers('text')}, '|') AS numbers FROM documents")
def number_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.number_tokens(F.col("text")), "|").alias("numbers"))


@query(f"""
WITH d AS (SELECT doc_id, {_numbers('text')} AS a, {_numbers("CASE WHEN doc_id % 2 = 0 THEN text || ' 7' ELSE replace(text, '1', '') END")} AS b FROM documents)
SELECT doc_id, len(list_filter(list_distinct(a), lambda n: len(list_filter(a, lambda x: x = n)) > len(list_filter(b, lambda x: x = n)))) = 0 AS preserved FROM d""")
def numbers_preserved(spark, sf_dir):
    answer = _pick("doc_id", F.concat("text", F.lit(" 7")), F.replace(F.col("text"), F.lit("1"), F.lit("")))
    return _read(spark, sf_dir, "documents").select("doc_id", T.numbers_preserved(F.col("text"), answer).alias("preserved"))


def _pairs(x: str, names: tuple[int, ...]) -> str:
    """Whether a text has each of these placeholders once, well-paired, and no other one of the first six."""
    return " AND ".join(f"len(regexp_extract_all({x}, '(?s)<PH_{k}>.*?</PH_{k}>')) = {int(k in names)}" for k in range(6))


@query(f"""
SELECT doc_id, {_pairs('t', (0, 1))} AS ok FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<PH_0>a</PH_0>' || text || '<PH_1>b</PH_1>' WHEN 1 THEN '<PH_0>a</PH_0>' || text || '<PH_1>b</PH_2>' WHEN 2 THEN text
    ELSE '<PH_1>b</PH_1>' || text || '<PH_0>a</PH_0>' END AS t FROM documents)""")
def placeholder_check(spark, sf_dir):
    both = F.concat(F.lit("<PH_0>a</PH_0>"), F.col("text"), F.lit("<PH_1>b</PH_1>"))
    wrong = F.concat(F.lit("<PH_0>a</PH_0>"), F.col("text"), F.lit("<PH_1>b</PH_2>"))
    swapped = F.concat(F.lit("<PH_1>b</PH_1>"), F.col("text"), F.lit("<PH_0>a</PH_0>"))
    answer = _pick("doc_id", both, wrong, F.col("text"), swapped)
    return _read(spark, sf_dir, "documents").select("doc_id", T.placeholders_match(answer, F.array(F.lit("PH_0"), F.lit("PH_1"))).alias("ok"))


_SAID = "text || CASE conv_id % 5 WHEN 0 THEN ' I cannot comply.' WHEN 1 THEN ' See our policy here' WHEN 2 THEN ' 抱歉，我无法协助翻译该内容。' WHEN 3 THEN ' 我们可能无法维持增长' ELSE '' END"


@query(f"SELECT conv_id, turn, coalesce({_refused('t')}, false) AS refused FROM (SELECT conv_id, turn, lower({_SAID}) AS t FROM conversations)")
def refusal_flags(spark, sf_dir):
    tail = _pick("conv_id", " I cannot comply.", " See our policy here", " 抱歉，我无法协助翻译该内容。", " 我们可能无法维持增长", "")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(T.looks_like_refusal(F.concat("text", tail)), F.lit(False)).alias("refused"))


@query("SELECT conv_id, turn, coalesce(contains(text, chr(65533)), false) OR conv_id % 7 = 0 AS damaged FROM conversations")
def replacement_char(spark, sf_dir):
    t = F.concat(F.coalesce("text", F.lit("")), _pick("conv_id", "�", "", "", "", "", "", ""))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.has_replacement_character(t).alias("damaged"))


def _payload(x: str) -> str:
    """A text without its code fence, from the first bracket to the last one."""
    bare = rf"CASE WHEN starts_with(trim({x}), '```') THEN regexp_replace(regexp_replace(trim({x}), '^```(?:json)?\s*', '', 'i'), '\s*```\s*$', '') ELSE trim({x}) END"
    return rf"coalesce(nullif(regexp_extract({bare}, '(?s)([\[{{].*[\]}}])', 1), ''), {bare})"


@query(f"""
SELECT event_id, {_payload('w')} AS payload FROM (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here: ' || props || ' bye' WHEN 2 THEN props ELSE 'no payload' END AS w FROM events)""")
def json_payload_slice(spark, sf_dir):
    wrapped = _pick("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Here: "), "props", F.lit(" bye")), F.col("props"), F.lit("no payload"))
    return _read(spark, sf_dir, "events").select("event_id", T.json_payload(wrapped).alias("payload"))


@query(f"""
WITH r AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure: [{{"id":"a","text":' || CAST(user_id AS VARCHAR) || '}}]' WHEN 1 THEN '```json' || chr(10) || '{{"id":"b","text":"' || event_type || '"}}' || chr(10) || '```'
    WHEN 2 THEN props || ']' ELSE 'I cannot do this.' END AS response FROM events
), p AS (SELECT event_id, {_refused('lower(response)')} AS refused, {_payload('response')} AS p FROM r),
j AS (SELECT event_id, refused, CASE WHEN NOT refused AND json_valid(p) THEN CASE WHEN json_type(p) = 'ARRAY' THEN json_extract(p, '$[0]') ELSE json(p) END END AS x FROM p)
SELECT event_id, CASE WHEN json_exists(x, '$.id') AND json_exists(x, '$.text') THEN json_extract_string(x, '$.id') || '|' || json_extract_string(x, '$.text') END AS first,
       CASE WHEN refused THEN 'model_refusal' WHEN x IS NULL OR NOT json_exists(x, '$.id') OR NOT json_exists(x, '$.text') THEN 'model_response_invalid' END AS reason FROM j""")
def parse_responses(spark, sf_dir):
    many = F.concat(F.lit('Sure: [{"id":"a","text":'), F.col("user_id").cast("string"), F.lit("}]"))
    one = F.concat(F.lit('```json\n{"id":"b","text":"'), "event_type", F.lit('"}\n```'))
    rows = _read(spark, sf_dir, "events").select("event_id", _pick("event_id", many, one, F.concat("props", F.lit("]")), F.lit("I cannot do this.")).alias("response"), F.lit(None).cast("string").alias("error"))
    first = F.get("items", F.lit(0))
    return V.parse_responses(rows).select("event_id", F.concat(first["id"], F.lit("|"), first["text"]).alias("first"), "reason")


_VALID = rf"""
WITH a AS (
  SELECT doc_id, 'In 2024: ' || text AS source, CASE doc_id % 6 WHEN 0 THEN 'In 2024: ' || text WHEN 1 THEN ' ' || chr(10) WHEN 2 THEN 'In 2024: ' || text || ' policy' WHEN 3 THEN 'In 2024: ' || text || chr(65533)
    WHEN 4 THEN 'In 2024: ' || text || '<PH_0>x</PH_0>' ELSE replace('In 2024: ' || text, '2024', '') END AS answer FROM documents
), t AS (SELECT doc_id, regexp_replace(answer, '^{_WS}+|{_WS}+$', '', 'g') AS t, {_numbers("source")} AS x, {_numbers("answer")} AS y FROM a),
v AS (
  SELECT doc_id, CASE WHEN t = '' THEN 'empty_translation' WHEN {_refused("lower(t)")} THEN 'model_refusal' WHEN contains(t, chr(65533)) THEN 'replacement_character_validation_failed'
    WHEN NOT ({_pairs("t", ())}) THEN 'placeholder_validation_failed'
    WHEN len(list_filter(list_distinct(x), lambda n: len(list_filter(x, lambda z: z = n)) > len(list_filter(y, lambda z: z = n)))) > 0 THEN 'number_validation_failed' END AS reason FROM t
)"""


def _validated(spark, sf_dir):
    source = F.concat(F.lit("In 2024: "), "text")
    answer = _pick("doc_id", source, F.lit(" \n"), F.concat(source, F.lit(" policy")), F.concat(source, F.lit("�")), F.concat(source, F.lit("<PH_0>x</PH_0>")), F.replace(source, F.lit("2024"), F.lit("")))
    return _read(spark, sf_dir, "documents").select("doc_id", V.unit_failure(source, answer, F.array().cast("array<string>")).alias("reason"))


@query(_VALID + " SELECT doc_id, reason FROM v")
def validate_first_failure(spark, sf_dir):
    return _validated(spark, sf_dir)


@query(_VALID + " SELECT doc_id % 10 AS doc_id, reason, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY 1, 2")
def failure_histogram(spark, sf_dir):
    return R.failure_histogram(_validated(spark, sf_dir).withColumn("doc_id", F.col("doc_id") % 10).withColumn("reason", F.concat("reason", F.lit(": detail"))))


# --- submissions ----------------------------------------------------------------------------------------------------


def _submissions(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang"), F.translate("text", "<>&", "   ").alias("t"))
    head = F.concat(F.lit("<SEC-DOCUMENT>\n<SEC-HEADER>0001.hdr.sgml\nACCESSION NUMBER:\t\t"), F.col("doc_id").cast("string"), F.lit("\n  company conformed name:  Firm: "), "lang", F.lit("\nOTHER: x\nCOMPANY CONFORMED NAME: second\nFISCAL YEAR END:\n</SEC-HEADER>\n"))
    kinds = _pick("doc_id", "a.htm", "b.XHTML", "c.png", "d.xsd", "e.xml", "f.txt", "g.pdf", "R1")
    one = F.concat(F.lit("<DOCUMENT>\n<TYPE>20-F\n<SEQUENCE>1\n<FILENAME>"), kinds, F.lit("\n<DESCRIPTION>Main\n<TEXT>\n"), F.trim(F.regexp_replace("t", r"[\s]+", " ")), F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    two = F.concat(F.lit("<DOCUMENT>\n<TYPE>"), _pick("doc_id", "GRAPHIC", "EX-101.INS", "ZIP"), F.lit("\n<SEQUENCE>x\n<FILENAME>data.bin\n<TEXT>QUJD</TEXT>\n</DOCUMENT>"))
    return d.select(F.col("doc_id").cast("string").alias("filing_id"), F.concat(head, one, two).alias("submission"))


@query(r"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS filing_id, doc_id, trim(regexp_replace(translate(text, '<>&', '   '), '[\s\x0b]+', ' ', 'g')) AS t FROM documents)
SELECT filing_id, 0 AS doc_ordinal, 1 AS sequence, '20-F' AS doc_type, list_extract(['a.htm', 'b.XHTML', 'c.png', 'd.xsd', 'e.xml', 'f.txt', 'g.pdf', 'R1'], doc_id % 8 + 1) AS filename, 'Main' AS description, sha256(t) AS text,
       list_extract(['html', 'html', 'image', 'xbrl', 'xml', 'text', 'binary', 'unknown'], doc_id % 8 + 1) AS content_kind FROM d
UNION ALL SELECT filing_id, 1, NULL, list_extract(['GRAPHIC', 'EX-101.INS', 'ZIP'], doc_id % 3 + 1), 'data.bin', '', sha256('QUJD'), list_extract(['image', 'xbrl', 'unknown'], doc_id % 3 + 1) FROM d""")
def submission_split(spark, sf_dir):
    return S.split_documents(_submissions(spark, sf_dir)).drop("error").withColumn("text", F.sha2("text", 256))


@query("SELECT CAST(doc_id AS VARCHAR) AS filing_id, CAST(doc_id AS VARCHAR) AS accession, 'Firm: ' || lang AS company, '' AS year_end, 3 AS n FROM documents")
def header_fields(spark, sf_dir):
    m = S.header_fields(F.col("submission"))
    return _submissions(spark, sf_dir).select("filing_id", m.alias("m")).select("filing_id", F.col("m")["accession_number"].alias("accession"), F.col("m")["company_name"].alias("company"), F.col("m")["fiscal_year_end"].alias("year_end"), F.size("m").alias("n"))


def _payload_texts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filing_id"), "doc_id", F.col("text").alias("t")).withColumn("b", F.replace(F.base64(F.col("t").cast("binary")), F.lit("\r\n"), F.lit("")))
    uu = F.lit("begin 644 cat.txt\n#0V%T\n`\nend")
    text = _pick("doc_id", F.col("b"), F.concat(F.col("b"), F.lit("*")), F.concat(F.lit("note "), F.col("t")), uu, F.lit("begin 644 x\nM\u00e9"))
    kind = _pick("doc_id", "image", "binary", "text", "text", "html")
    return d.select("filing_id", F.lit(0).alias("doc_ordinal"), text.alias("text"), kind.alias("content_kind"))


@query("""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS filing_id, doc_id % 5 AS k, text AS t, base64(encode(text)) || '*' AS raw FROM documents)
SELECT filing_id, CASE k WHEN 0 THEN 'base64' WHEN 1 THEN 'raw' WHEN 3 THEN 'uuencode' ELSE 'text' END AS decode_status,
       CASE k WHEN 0 THEN sha256(t) WHEN 1 THEN sha256(raw) WHEN 2 THEN sha256('note ' || t) WHEN 3 THEN sha256('Cat') WHEN 4 THEN sha256('begin 644 x' || chr(10) || 'M\u00e9') END AS payload,
       CAST(CASE k WHEN 0 THEN octet_length(encode(t)) WHEN 1 THEN length(raw) WHEN 2 THEN length(t) + 5 WHEN 3 THEN 3 WHEN 4 THEN 14 END AS BIGINT) AS size FROM d""")
def decode_payloads(spark, sf_dir):
    """Payloads of the whole texts: base64, what is nearly base64, plain, uuencoded and nearly uuencoded."""
    return S.decode_payloads(_payload_texts(spark, sf_dir)).select("filing_id", "decode_status", F.sha2("payload", 256).alias("payload"), "size")


_KINDS = "list_extract(['html', 'html', 'image', 'xbrl', 'xml', 'text', 'binary', 'unknown'], doc_id % 8 + 1)"
_PACKED = rf"regexp_replace(t, '{_WS}+', '', 'g')"


@query(rf"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS filing_id, doc_id, lang, trim(regexp_replace(translate(text, '<>&', '   '), '[\s\x0b]+', ' ', 'g')) AS t FROM documents),
k AS (SELECT *, {_KINDS} AS kind, doc_id % 8 IN (2, 6) AS bin, length({_PACKED}) % 4 = 0 AND regexp_full_match({_PACKED}, '[A-Za-z0-9+/]*={{0,2}}') AS packs FROM d),
z AS (SELECT *, CASE WHEN bin AND packs THEN 'base64' WHEN bin THEN 'raw' ELSE 'text' END AS status FROM k)
SELECT filing_id, '{{"source":"' || filing_id || '","filing":{{"accession_number":"' || filing_id || '","company_name":"Firm: ' || lang || '","fiscal_year_end":""}},"documents":['
  || '{{"doc_ordinal":0,"sequence":1,"type":"20-F","filename":"' || list_extract(['a.htm', 'b.XHTML', 'c.png', 'd.xsd', 'e.xml', 'f.txt', 'g.pdf', 'R1'], doc_id % 8 + 1) || '","description":"Main","content_kind":"' || kind
  || '","decode_status":"' || status || '","size":' || CAST(CASE status WHEN 'base64' THEN length({_PACKED}) // 4 * 3 - length(regexp_extract({_PACKED}, '=*$')) WHEN 'raw' THEN octet_length(encode(t)) ELSE length(t) END AS VARCHAR) || '}},'
  || '{{"doc_ordinal":1,"type":"' || list_extract(['GRAPHIC', 'EX-101.INS', 'ZIP'], doc_id % 3 + 1) || '","filename":"data.bin","description":"","content_kind":"' || list_extract(['image', 'xbrl', 'unknown'], doc_id % 3 + 1)
  || '","decode_status":"' || CASE doc_id % 3 WHEN 0 THEN 'base64","size":3' ELSE 'text","size":4' END || '}}]}}' AS manifest FROM z""")
def manifests(spark, sf_dir):
    s = _submissions(spark, sf_dir)
    d = S.split_documents(s)
    return S.manifests(s, d, S.decode_payloads(d))


# --- cache ----------------------------------------------------------------------------------------------------------


def _keyed(spark, sf_dir):
    parts = (F.lit("f"), F.col("unit_id"), F.col("text"), F.array(F.lit("PH_2"), F.lit("PH_10")), F.lit("p"), F.lit("zh"), F.lit("m"))
    return _units(spark, sf_dir).withColumn("cache_key", C.cache_key(*parts))


_KEYED = _UNITS + ", k AS (SELECT *, sha256('f' || chr(10) || unit_id || chr(10) || sha256(text) || chr(10) || 'PH_10,PH_2' || chr(10) || 'p' || chr(10) || 'zh' || chr(10) || 'm') AS cache_key FROM u)"


@query(f"WITH {_KEYED} SELECT doc_id, unit_id, cache_key FROM k")
def cache_key(spark, sf_dir):
    return _keyed(spark, sf_dir).select("doc_id", "unit_id", "cache_key")


def _cache(spark, sf_dir):
    rows = _keyed(spark, sf_dir).where("doc_id % 3 <> 0").groupBy("cache_key").agg(F.min("doc_id").alias("d"))
    return rows.select("cache_key", F.concat(F.lit("t"), F.col("d").cast("string")).alias("text"), F.when(F.col("d") % 2 == 0, "source").otherwise("m").alias("provider"))


_CACHED = _KEYED + ", c AS (SELECT cache_key, 't' || CAST(min(doc_id) AS VARCHAR) AS text, CASE WHEN min(doc_id) % 2 = 0 THEN 'source' ELSE 'm' END AS provider FROM k WHERE doc_id % 3 <> 0 GROUP BY 1)"


@query(f"WITH {_CACHED} SELECT k.doc_id, k.unit_id, c.text AS cached_text, c.provider AS cached_provider FROM k LEFT JOIN c USING (cache_key)")
def cache_hits(spark, sf_dir):
    return C.lookup(_keyed(spark, sf_dir), _cache(spark, sf_dir)).select("doc_id", "unit_id", "cached_text", "cached_provider")


@query(f"WITH {_CACHED} SELECT doc_id, unit_id FROM k ANTI JOIN c USING (cache_key)")
def cache_misses(spark, sf_dir):
    return C.misses(_keyed(spark, sf_dir), _cache(spark, sf_dir)).select("doc_id", "unit_id")


@query(f"WITH {_CACHED} SELECT k.doc_id, k.unit_id, 'cached_source_retained' AS reason FROM k JOIN c USING (cache_key) WHERE c.provider = 'source'")
def retained_from_cache(spark, sf_dir):
    return C.retained_from_cache(C.lookup(_keyed(spark, sf_dir), _cache(spark, sf_dir))).select("doc_id", "unit_id", "reason")


@query("SELECT CAST(user_id AS VARCHAR) AS cache_key, arg_max(event_type, event_id) AS text FROM events WHERE event_id % 11 <> 0 GROUP BY 1")
def cache_last_wins(spark, sf_dir):
    text = F.when(F.col("event_id") % 11 == 0, F.lit("�")).otherwise(F.col("event_type"))
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cache_key"), text.alias("text"), F.col("event_id").alias("seq"))
    return C.last_wins(rows).select("cache_key", "text")


@query("""
WITH l AS (
  SELECT event_id AS seq, event_id % 3 AS run, CAST(user_id AS VARCHAR) AS k, event_type AS t, event_id % 7 AS kind FROM events
), v AS (SELECT * FROM l WHERE kind NOT IN (1, 2, 3, 4, 5))
SELECT k AS cache_key, arg_max(t, run * 1000000000 + seq) AS text, arg_max(CASE WHEN seq % 2 = 0 THEN 'source' ELSE 'm' END, run * 1000000000 + seq) AS provider FROM v GROUP BY 1""")
def cache_log(spark, sf_dir):
    """The log from its lines: blank, broken, listed, nameless and damaged ones are left out; the latest run wins, then the latest line."""
    row = F.struct(F.col("user_id").cast("string").alias("cache_key"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 2 == 0, "source").otherwise("m").alias("provider"), (F.col("event_id") % 3).alias("run"))
    damaged = F.to_json(F.struct(F.col("user_id").cast("string").alias("cache_key"), F.lit("\ufffd").alias("text"), F.lit(9).alias("run")))
    nameless = F.to_json(F.struct(F.lit("").alias("cache_key"), F.col("event_type").alias("text")))
    line = _pick("event_id", F.to_json(row), F.lit(" "), F.concat(F.to_json(row), F.lit("}")), F.concat(F.lit("["), F.to_json(row), F.lit("]")), nameless, damaged, F.to_json(row))
    lines = _read(spark, sf_dir, "events").select(line.alias("value"), F.struct(F.lit("a.jsonl").alias("file"), F.col("event_id").alias("line")).alias("seq"))
    return C.last_wins(C.parse_lines(lines)).select("cache_key", "text", "provider")


# --- planning -------------------------------------------------------------------------------------------------------

_BATCHES = f"""
WITH RECURSIVE {_UNITS}, s AS (SELECT doc_id, ordinal, unit_id, text, length(text) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r FROM u),
g AS (
  SELECT doc_id, ordinal, unit_id, text, r, 1 AS batch_no, 1 AS n, size AS chars FROM s WHERE r = 1
  UNION ALL
  SELECT s.doc_id, s.ordinal, s.unit_id, s.text, s.r, CASE WHEN g.n >= 3 OR g.chars + s.size > 250 THEN g.batch_no + 1 ELSE g.batch_no END,
         CASE WHEN g.n >= 3 OR g.chars + s.size > 250 THEN 1 ELSE g.n + 1 END, CASE WHEN g.n >= 3 OR g.chars + s.size > 250 THEN s.size ELSE g.chars + s.size END
  FROM g JOIN s ON s.doc_id = g.doc_id AND s.r = g.r + 1
)"""


def _batched(spark, sf_dir):
    return P.greedy_batches(_units(spark, sf_dir), 3, 250)


@query(_BATCHES + " SELECT doc_id, ordinal, CAST(batch_no AS INTEGER) AS batch_no FROM g")
def greedy_batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("doc_id", "ordinal", "batch_no")


@query(_BATCHES + """, b AS (SELECT doc_id, batch_no, min(r) AS lo, max(r) AS hi FROM g GROUP BY 1, 2),
l AS (SELECT doc_id, r, ordinal, unit_id || ': ' || text AS line, length(unit_id || ': ' || text) + 1 AS n FROM g),
f AS (SELECT b.doc_id, b.batch_no, l.r, l.line, l.ordinal, sum(l.n) OVER (PARTITION BY b.doc_id, b.batch_no ORDER BY l.r DESC) AS t, l.r = b.lo - 1 AS next FROM b JOIN l ON l.doc_id = b.doc_id AND l.r < b.lo)
SELECT b.doc_id, CAST(b.batch_no AS INTEGER) AS batch_no, coalesce((SELECT string_agg(line, chr(10) ORDER BY r) FROM f WHERE f.doc_id = b.doc_id AND f.batch_no = b.batch_no AND (t <= 300 OR next)), '') AS context_before FROM b""")
def context_before(spark, sf_dir):
    dense = _batched(spark, sf_dir).withColumn("ordinal", F.expr("CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS INT)"))
    return P.with_contexts(dense, 300, 0).select("doc_id", "batch_no", "context_before")


@query(_BATCHES + """, b AS (SELECT DISTINCT doc_id, batch_no FROM g)
SELECT doc_id, CAST(batch_no AS INTEGER) AS batch_no, array_to_string(list(batch_no) OVER (PARTITION BY doc_id ORDER BY batch_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS near FROM b""")
def mini_blocks(spark, sf_dir):
    rows = _batched(spark, sf_dir).groupBy("doc_id", "batch_no").agg(F.collect_list("unit_id").alias("items")).withColumn("block_no", F.lit(1))
    return P.mini_blocks(rows).select("doc_id", "batch_no", F.array_join(F.transform("near", lambda x: x["batch_no"].cast("string")), ",").alias("near"))


@query(_BATCHES.replace("WITH RECURSIVE", "WITH RECURSIVE") + """, z AS (
  SELECT doc_id, batch_no, sum(length(CAST(to_json({'id': unit_id, 'text': text}) AS VARCHAR)) + 3) + 2 * count(*) - 2 + length('{"batch_id": "batch_001", "items": []}') + 2 AS own FROM g GROUP BY 1, 2
), k AS (
  SELECT doc_id, batch_no, 1 AS block_no, 1 AS n, own AS chars FROM z WHERE batch_no = 1
  UNION ALL
  SELECT z.doc_id, z.batch_no, CASE WHEN k.n >= 5 OR (k.chars + z.own + 1) // 2 > 400 THEN k.block_no + 1 ELSE k.block_no END,
         CASE WHEN k.n >= 5 OR (k.chars + z.own + 1) // 2 > 400 THEN 1 ELSE k.n + 1 END, CASE WHEN k.n >= 5 OR (k.chars + z.own + 1) // 2 > 400 THEN z.own ELSE k.chars + z.own END
  FROM k JOIN z ON z.doc_id = k.doc_id AND z.batch_no = k.batch_no + 1
)
SELECT doc_id, CAST(batch_no AS INTEGER) AS batch_no, CAST(block_no AS INTEGER) AS block_no FROM k""")
def plan_blocks(spark, sf_dir):
    return P.plan_blocks(_batched(spark, sf_dir), 400, 5)


# --- calls, ladder, reports -----------------------------------------------------------------------------------------


@query("""
SELECT event_type AS model, count(*) FILTER (WHERE event_id % 5 <> 0) AS requests, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN user_id ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens,
       CAST(sum(CASE WHEN event_id % 5 <> 0 THEN user_id ELSE 0 END) AS BIGINT) AS total_tokens, CAST(count(*) FILTER (WHERE event_id % 5 <> 0) * 8 AS BIGINT) AS prompt_cache_hit_tokens,
       CAST(count(*) FILTER (WHERE event_id % 5 <> 0) * 2 AS BIGINT) AS prompt_cache_miss_tokens, 0.8::DOUBLE AS prompt_cache_hit_ratio
FROM events GROUP BY 1""")
def usage_report(spark, sf_dir):
    known = F.col("event_id") % 5 != 0
    n = F.when(known, F.col("user_id"))
    rows = _read(spark, sf_dir, "events").select(F.col("event_type").alias("model"), n.alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"), n.alias("total_tokens"), F.when(known, 8).alias("prompt_cache_hit_tokens"), F.when(known, 2).alias("prompt_cache_miss_tokens"))
    return usage_totals(rows)


def _keyed_provider():
    return KeyedProvider("keyed", make=lambda t: "�" if len(t) % 10 == 3 else t.upper())


def _fallback_provider():
    return KeyedProvider("second", make=lambda t: "" if len(t) % 20 == 3 else t.lower())


def _ran(spark, sf_dir):
    return L.run_ladder(P.greedy_batches(_units(spark, sf_dir), 4, 2000), _keyed_provider, _fallback_provider)


@query(f"WITH {_UNITS} SELECT doc_id, unit_id, CASE WHEN length(text) % 20 = 3 THEN 'source' WHEN length(text) % 10 = 3 THEN 'second' ELSE 'keyed' END AS provider FROM u")
def ladder_results(spark, sf_dir):
    return _ran(spark, sf_dir)[0].select("doc_id", "unit_id", "provider")


_ANSWERED = "CASE WHEN length(text) % 20 = 3 THEN 'source' WHEN length(text) % 10 = 3 THEN 'second' ELSE 'keyed' END"


@query(f"""WITH {_UNITS}, p AS (SELECT doc_id, {_ANSWERED} AS p FROM u)
SELECT doc_id, count(*) AS total_units, count(*) FILTER (WHERE p = 'keyed') AS primary_success, count(*) FILTER (WHERE p = 'second') AS fallback_success, count(*) FILTER (WHERE p = 'source') AS source_retained FROM p GROUP BY 1""")
def ladder_summary(spark, sf_dir):
    """The counters of the ladder's reports, read back from their JSON."""
    report = F.from_json("report", "summary struct<total_units:bigint,primary_success:bigint,fallback_success:bigint,source_retained:bigint>")
    return R.reports(*_ran(spark, sf_dir)).select("doc_id", report["summary"].alias("s")).select("doc_id", "s.*")


@query(None)
def ladder_reports(spark, sf_dir):
    return R.reports(*_ran(spark, sf_dir))


def _narrow_provider():
    """A model whose context holds two batches of a block."""

    class Narrow(KeyedProvider):
        def translate(self, request):
            if request["prompt"].count('"batch_id"') > 2:
                raise RuntimeError("maximum context length exceeded")
            return super().translate(request)

    return Narrow("keyed", make=lambda t: "\ufffd" if len(t) % 10 == 3 else f"one: {t}")


def _wide_provider():
    return KeyedProvider("keyed", make=lambda t: "\ufffd" if len(t) % 10 == 3 else f"one: {t}")


def _second_provider():
    return KeyedProvider("second", make=lambda t: "" if len(t) % 20 == 3 else f"two: {t}")


_RUN = f"""WITH {_UNITS} SELECT doc_id, unit_id, {_ANSWERED} AS provider,
  CASE WHEN length(text) % 20 = 3 THEN text WHEN length(text) % 10 = 3 THEN 'two: ' || text ELSE 'one: ' || text END AS result FROM u"""


@query(_RUN)
def block_run(spark, sf_dir):
    """Block mode over all documents: prompts that do not fit shrink to what does."""
    config = Config(batch=Batch(max_units=4), block=Block(enabled=True, target_batch_units=4, max_batch_chars=2000, max_batches_per_block=6, max_workers=16, warmup_delay_seconds=0.0), model=Model("keyed", max_retries=1))
    return W.blocks(_units(spark, sf_dir), _narrow_provider, _second_provider, config)[0].select("doc_id", "unit_id", "provider", "result")


@query(f"""
WITH {_UNITS}, d AS (
  SELECT doc_id, CAST(1 + doc_id % 9 AS INTEGER) AS most, CAST(doc_id % 5 AS INTEGER) AS good, min(CASE WHEN length(text) % 10 = 3 THEN ordinal END) FILTER (WHERE ordinal <= 4) AS stop, max(ordinal) FILTER (WHERE ordinal <= 4) AS last FROM u GROUP BY doc_id
), g AS (SELECT *, good + coalesce(stop - 1, last, 0) AS now FROM d)
SELECT doc_id, CAST(CASE WHEN stop IS NOT NULL AND most > 1 THEN CASE WHEN most // 2 >= 1 AND most // 2 < most THEN most // 2 ELSE most - 1 END
  WHEN stop IS NULL AND now >= 5 THEN greatest(most, least(8, greatest(most + 1, CAST(floor(most * 1.25) AS INTEGER)))) ELSE most END AS INTEGER) AS most,
  CAST(CASE WHEN (stop IS NOT NULL AND most > 1) OR now >= 5 THEN 0 ELSE now END AS INTEGER) AS good FROM g""")
def block_states(spark, sf_dir):
    """How many batches a document's blocks may have after a round, in which some of its first four blocks did not fit."""
    units = _units(spark, sf_dir)
    state = units.select("doc_id").distinct().select("doc_id", (F.lit(1) + F.pmod("doc_id", F.lit(9))).cast("int").alias("most"), F.pmod("doc_id", F.lit(5)).cast("int").alias("good"))
    done = units.where("ordinal <= 4").select("doc_id", F.col("ordinal").alias("block_no"), (F.char_length("text") % 10 == 3).alias("limited"))
    return next_state(state, done, Config(block=Block(max_batches_per_block=8)))


@query(_RUN)
def linear_run(spark, sf_dir):
    """Linear mode over all documents, with validation, shrinking batches and the fallback model."""
    return W.linear(_units(spark, sf_dir), _wide_provider, _second_provider)[0].select("doc_id", "unit_id", "provider", "result")


@query("""
SELECT user_id % 50 AS doc_id, count(*) AS total_units, count(*) FILTER (WHERE event_id % 6 = 0) AS cache_hits, count(*) FILTER (WHERE event_id % 6 = 1) AS primary_success, count(*) FILTER (WHERE event_id % 6 = 2) AS repair_success,
       count(*) FILTER (WHERE event_id % 6 = 3) AS mini_block_success, count(*) FILTER (WHERE event_id % 6 = 4) AS fallback_success, count(*) FILTER (WHERE event_id % 6 = 5) AS source_retained FROM events GROUP BY 1""")
def report_summary(spark, sf_dir):
    rung = _pick("event_id", "cache", "primary", "repair-0", "mini", "fallback", "source")
    return R.summary(_read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("doc_id"), rung.alias("rung"), F.lit("m").alias("provider")))


# --- pages ----------------------------------------------------------------------------------------------------------


@query(None)
def extract_units(spark, sf_dir):
    return H.extract_units(_read(spark, sf_dir, "pages"), "page_id")


@query(None)
def extract_units_stats(spark, sf_dir):
    units = H.extract_units(_read(spark, sf_dir, "pages"), "page_id")
    return units.groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.char_length("text")).alias("chars"), F.sum(F.size("placeholders")).alias("placeholders"))


@query(None)
def apply_units(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    answers = H.extract_units(pages, "page_id").select("doc_id", "ordinal", F.upper("text").alias("text"), (F.col("ordinal") % 7 == 0).alias("is_fallback"))
    return H.apply_units(pages.select("page_id", "html"), answers, "page_id")


@query(None)
def zero_byte_files(spark, sf_dir):
    return empty_files(spark, sf_dir)
