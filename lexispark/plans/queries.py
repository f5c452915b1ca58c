"""The library's registered queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.functions import urls as U
from lexispark.functions.stemmer import stem_column
from lexispark.operators import boolean, corpus, crawl, index, search, zipf
from lexispark.sources import readers, writers
from lexispark.storage import new_path
from lexispark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

NOW = 1_700_000_000
DOMAINS = ("example.com", "example.org")
CONFIG = crawl.Config(allowed_domains=DOMAINS, max_html_bytes=2_000_000)
MIN_WORDS = 300
RANKED, REPEATED = "the of thontion ing", "the the of ing"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


_stored: dict[tuple, str] = {}


def _index(spark: SparkSession, d: str, stem: bool = False) -> index.Index:
    """The documents' index, written once a session and read as any search reads one: clustered by term."""
    key = (spark.sparkContext.applicationId, d, stem)
    if key not in _stored:
        at = new_path(spark, "index")
        writers.write_index(index.build(_docs(spark, d).select("doc_id", "text"), stem=stem), at)
        _stored[key] = at
    return readers.read_index(spark, _stored[key])


def _post(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_docs(spark, d).select("doc_id", "text"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return index.blocks(_docs(spark, d).select("doc_id", "text"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return index.term_counts(_docs(spark, d))


# ---- SQL building blocks -------------------------------------------------------------------------------------------
_TOK = f"list_transform(regexp_extract_all(coalesce(text, ''), '{T.TOKEN_RE2}'), lambda x: lower(x))"
_T = f"t AS (SELECT doc_id, text, {_TOK} AS toks FROM documents)"
_P = _T + ", p AS (SELECT term, doc_id, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY 1, 2)"
_BLANK = r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_clean = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '{_BLANK}', ' ', 'g'))"
_CLEAN = _clean("text")
#: The whole labelled document of a paper row.
_DOCUMENT = f"'Title: Paper ' || doc_id || chr(10) || chr(10) || 'Abstract: ' || {_clean('left(text, 40)')} || chr(10) || chr(10) || 'Full text:' || chr(10) || cleaned || chr(10)"
_C = f"c AS (SELECT doc_id, text, source, {_CLEAN} AS cleaned FROM documents), w AS (SELECT *, CASE WHEN cleaned = '' THEN 0 ELSE len(string_split(cleaned, ' ')) END::BIGINT AS word_count FROM c)"
_NAME = "'doc_' || CASE WHEN {0} < 1000000 THEN lpad({0}::VARCHAR, 6, '0') ELSE {0}::VARCHAR END || '.txt'"


# ---- corpus --------------------------------------------------------------------------------------------------------
@query("clean_text_word_count", f"WITH {_C} SELECT doc_id, md5(cleaned) AS cleaned_md5, word_count, strlen(coalesce(text, ''))::BIGINT AS bytes, length(coalesce(text, ''))::BIGINT AS chars FROM w")
def clean_text_word_count(spark, d):
    c = _docs(spark, d).withColumn("cleaned", T.clean_text(F.col("text")))
    t = F.coalesce("text", F.lit(""))
    return c.select("doc_id", F.md5("cleaned").alias("cleaned_md5"), T.word_count(F.col("cleaned")).alias("word_count"), F.octet_length(t).cast("long").alias("bytes"), F.char_length(t).cast("long").alias("chars"))


def _papers(spark, d):
    return _docs(spark, d).select(
        "doc_id", F.concat(F.lit("Paper "), "doc_id").alias("title"), F.substring("text", 1, 40).alias("abstract"), F.col("text").alias("full_text"), F.concat(F.lit("P"), "doc_id").alias("acl_id"), F.lit("2020").alias("year"), F.col("source").alias("author"), F.concat(F.lit("https://example.org/"), "doc_id").alias("url")
    )


_PAPERS = "SELECT 'Paper ' || doc_id AS title, left(text, 40) AS abstract, text AS full_text, 'P' || doc_id AS acl_id, '2020' AS year, source AS author, 'https://example.org/' || doc_id AS url FROM documents"


@query("papers_scan", _PAPERS)
def papers_scan(spark, d):
    at = new_path(spark, "papers")
    _papers(spark, d).withColumn("other", F.lit(1)).write.parquet(at)
    return readers.read_papers(spark, at)


def _report_sql(cap: int) -> str:
    return f"""WITH {_C}, r AS (SELECT doc_id, cleaned = '' AS empty, word_count >= {MIN_WORDS} AS long FROM w), k AS (SELECT doc_id FROM r WHERE NOT empty AND long ORDER BY doc_id LIMIT {cap}),
    s AS (SELECT * FROM r WHERE (SELECT count(*) FROM k) < {cap} OR doc_id <= (SELECT max(doc_id) FROM k))
    SELECT count(*) FILTER (NOT empty AND long) AS saved, count(*) FILTER (empty) AS skipped_empty, count(*) FILTER (NOT empty AND NOT long) AS skipped_short FROM s"""


@query("corpus_filter_report", _report_sql(corpus.MAX_DOCS))
def corpus_filter_report(spark, d):
    return corpus.filter_report(_papers(spark, d), "doc_id", MIN_WORDS)


@query("corpus_filter_report_capped", _report_sql(50))
def corpus_filter_report_capped(spark, d):
    return corpus.filter_report(_papers(spark, d), "doc_id", MIN_WORDS, 50)


def _extracted_sql(cap: int = corpus.MAX_DOCS) -> str:
    return f"""WITH {_C}, k AS (SELECT * FROM w WHERE cleaned <> '' AND word_count >= {MIN_WORDS} ORDER BY doc_id LIMIT {cap}), n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, *, {_DOCUMENT} AS document FROM k)"""


_META = f"""SELECT i AS doc_id, {_NAME.format('i')} AS file, 'P' || doc_id AS acl_id, 'Paper ' || doc_id AS title, source AS author, '2020' AS year, 'https://example.org/' || doc_id AS url, word_count, length(document)::BIGINT AS text_length FROM n"""


def _extracted(spark, d, cap: int = corpus.MAX_DOCS) -> DataFrame:
    return corpus.extract(_papers(spark, d).withColumnRenamed("doc_id", "row_id"), "row_id", MIN_WORDS, cap)


@query("corpus_extract_meta", f"{_extracted_sql()} {_META}")
def corpus_extract_meta(spark, d):
    return corpus.metadata(_extracted(spark, d))


@query("corpus_extract_capped", f"{_extracted_sql(50)} {_META}")
def corpus_extract_capped(spark, d):
    return corpus.metadata(_extracted(spark, d, 50))


@query("metadata_json_roundtrip", f"{_extracted_sql()} {_META}")
def metadata_json_roundtrip(spark, d):
    at, meta = new_path(spark, "meta"), corpus.metadata(_extracted(spark, d))
    writers.write_metadata(meta, at)
    return spark.read.schema(meta.schema).json(at)


@query("text_folder_roundtrip", f"{_extracted_sql()} SELECT i AS doc_id, {_NAME.format('i')} AS file, md5(document) AS text_md5 FROM n")
def text_folder_roundtrip(spark, d):
    at = new_path(spark, "corpus")
    writers.write_corpus(_extracted(spark, d), at)
    return readers.read_text_folder(spark, at).select("doc_id", F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.md5("text").alias("text_md5"))


@query("corpus_stats", f"WITH {_C} SELECT count(*) AS docs, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, sum(length(coalesce(text, '')))::BIGINT AS chars, sum(word_count)::BIGINT AS words, round(sum(strlen(coalesce(text, ''))) / count(*), 6) AS avg_bytes, round(sum(length(coalesce(text, ''))) / count(*), 6) AS avg_chars, round(sum(word_count) / count(*), 6) AS avg_words FROM w")
def corpus_stats(spark, d):
    """The size of the files that lie there is no matter of SQL, and left to the tests."""
    raw = corpus.raw_size(spark, f"{d}/documents.parquet")
    return corpus.corpus_stats(_docs(spark, d), raw).drop("raw_bytes").withColumns({c: F.round(c, 6) for c in ("avg_bytes", "avg_chars", "avg_words")})


@query("title_extract", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 5 = 1 THEN 'Title: ' || chr(10) || chr(10) || 'Abstract: x' ELSE 'Title: Paper ' || doc_id || chr(10) || chr(10) || 'Abstract: ' || left(text, 40) || chr(10) || chr(10) || 'Full text:' || chr(10) || text || chr(10) END AS text FROM documents)
    SELECT doc_id, regexp_extract(text, 'Title:[ \\t\\n\\x0B\\f\\r]*([^\\n]*)', 1) AS title FROM d""".replace("\\\\", "\\"))
def title_extract(spark, d):
    whole = T.document_text(F.concat(F.lit("Paper "), "doc_id"), F.substring("text", 1, 40), F.col("text"))
    text = F.when(F.col("doc_id") % 5 == 0, F.col("text")).when(F.col("doc_id") % 5 == 1, F.lit("Title: \n\nAbstract: x")).otherwise(whole)
    return _docs(spark, d).select("doc_id", T.extract_title(text).alias("title"))


# ---- tokens and index ----------------------------------------------------------------------------------------------
@query("tokenize_exploded", f"WITH {_T} SELECT doc_id, i - 1 AS position, toks[i] AS term FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM t)")
def tokenize_exploded(spark, d):
    return index.tokens(_docs(spark, d)).withColumn("position", F.col("position").cast("long"))


_UNICODE_RE2 = r"(?:[\p{L}\p{Nl}\p{No}]+|\p{Nd}+(?:\.\p{Nd}+)*)(?:[-'']?(?:[\p{L}\p{Nl}\p{No}]+|\p{Nd}+(?:\.\p{Nd}+)*))*"


@query("tokenize_unicode", f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_UNICODE_RE2}'), lambda x: lower(x)) AS t FROM documents)")
def tokenize_unicode(spark, d):
    t = T.tokenize(F.col("text"), unicode=True)
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("token_stats", f"WITH {_T}, n AS (SELECT strlen(coalesce(text, '')) AS b, len(toks) AS n, coalesce(list_sum(list_transform(toks, lambda x: length(x))), 0) AS l FROM t) SELECT count(*) AS files, sum(n)::BIGINT AS tokens, round(sum(l) / sum(n), 6) AS avg_token_length, sum(b)::BIGINT AS bytes, round(sum(b) / 1024, 6) AS kilobytes FROM n")
def token_stats(spark, d):
    return corpus.token_stats(_docs(spark, d)).withColumns({c: F.round(c, 6) for c in ("avg_token_length", "kilobytes")})


@query("doc_token_count", f"WITH {_T} SELECT doc_id, len(toks)::BIGINT AS token_count FROM t")
def doc_token_count(spark, d):
    return index.token_counts(_docs(spark, d))


@query("term_freq_postings", f"WITH {_P} SELECT term, doc_id, tf FROM p")
def term_freq_postings(spark, d):
    return _post(spark, d)


@query("inverted_lists", f"WITH {_P} SELECT term || chr(9) || string_agg(doc_id || ':' || tf, chr(9) ORDER BY doc_id) AS value FROM p GROUP BY term")
def inverted_lists(spark, d):
    return writers.postings_lines(_blocks(spark, d))


@query("vocab_df_offsets", f"WITH {_P}, v AS (SELECT term, count(*) AS df FROM p GROUP BY term) SELECT term, df, (8 * coalesce(sum(df) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS postings_offset, df AS postings_count FROM v")
def vocab_df_offsets(spark, d):
    return index.placed(index.frequencies(_blocks(spark, d)))


@query("index_header_stats", f"WITH {_P}, v AS (SELECT term, count(*) AS df FROM p GROUP BY term) SELECT (SELECT count(*) FROM t) AS docs, (SELECT sum(len(toks))::BIGINT FROM t) AS tokens, count(*) AS terms, sum(df)::BIGINT AS postings, round(avg(length(term)), 6) AS avg_term_length, sum(24 + length(term))::BIGINT AS vocab_bytes, (8 * sum(df))::BIGINT AS postings_bytes FROM v")
def index_header_stats(spark, d):
    return index.header_stats(_index(spark, d)).withColumn("avg_term_length", F.round("avg_term_length", 6))


@query("index_dump_preview", f"WITH {_P}, v AS (SELECT term, count(*) AS df FROM p GROUP BY term ORDER BY term LIMIT 5), r AS (SELECT term, df, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS nth, doc_id, tf FROM p JOIN v USING (term)) SELECT * FROM r WHERE nth <= 5")
def index_dump_preview(spark, d):
    return index.dump_terms(_index(spark, d)).withColumn("nth", F.col("nth").cast("long"))


@query("index_dump_docs", f"WITH {_T} SELECT doc_id, '' AS title, {_NAME.format('doc_id')} AS path, len(toks)::BIGINT AS token_count FROM t ORDER BY doc_id LIMIT 5")
def index_dump_docs(spark, d):
    return index.dump_docs(_index(spark, d))


@query("collection_term_freq_top", f"WITH {_P} SELECT term, sum(tf)::BIGINT AS freq FROM p GROUP BY term ORDER BY freq DESC, term LIMIT 100")
def collection_term_freq_top(spark, d):
    return _terms(spark, d).orderBy(F.desc("freq"), "term").limit(100)


@query("postings_lookup", f"WITH {_P} SELECT term, doc_id, tf FROM p WHERE term IN ('the', 'of', 'la')")
def postings_lookup(spark, d):
    return _index(spark, d).postings.where(F.col("term").isin("the", "of", "la"))


def _text_index(spark, d) -> str:
    at = new_path(spark, "text-index")
    writers.write_text_index(_index(spark, d), at)
    return at


@query("docs_tsv_roundtrip", f"SELECT doc_id, {_NAME.format('doc_id')} AS path FROM documents")
def docs_tsv_roundtrip(spark, d):
    return readers.read_docs_tsv(spark, f"{_text_index(spark, d)}/docs")


@query("postings_tsv_roundtrip", f"WITH {_P} SELECT term, doc_id, tf FROM p")
def postings_tsv_roundtrip(spark, d):
    return readers.read_postings_tsv(spark, f"{_text_index(spark, d)}/postings")


@query("dictionary_tsv_roundtrip", f"WITH {_P} SELECT term || chr(9) || count(*) AS value FROM p GROUP BY term")
def dictionary_tsv_roundtrip(spark, d):
    return spark.read.text(f"{_text_index(spark, d)}/dictionary")


@query("index_roundtrip", f"WITH {_P} SELECT term, doc_id, tf FROM p")
def index_roundtrip(spark, d):
    return _index(spark, d).postings


@query("binary_index_roundtrip", f"WITH {_P} SELECT term, doc_id, tf FROM p")
def binary_index_roundtrip(spark, d):
    at = new_path(spark, "binary-index")
    writers.write_binary_index(_index(spark, d), at)
    return readers.read_binary_index(spark, at).postings


# ---- ranked search -------------------------------------------------------------------------------------------------
def _ranked_sql(q: str) -> str:
    asked = ", ".join(f"('{t}', {n})" for t, n in search.query_terms(q).items())
    return f"""WITH {_P}, q(term, n) AS (VALUES {asked}), s AS (SELECT doc_id, sum(tf * n)::DOUBLE AS score FROM p JOIN q USING (term) GROUP BY doc_id)
    SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score, {_NAME.format('doc_id')} AS path FROM s ORDER BY score DESC, doc_id LIMIT 10"""


@query("ranked_top10", _ranked_sql(RANKED))
def ranked_top10(spark, d):
    return search.ranked(_index(spark, d), RANKED)


@query("ranked_top10_repeated_term", _ranked_sql(REPEATED))
def ranked_top10_repeated_term(spark, d):
    return search.ranked(_index(spark, d), REPEATED)


@query("ranked_top10_stemmed")
def ranked_top10_stemmed(spark, d):
    return search.ranked(_index(spark, d, stem=True), "inging thontions the", stem_query=True)


_BATCH = {"q1": "the of", "q2": "la la que", "q3": "und der die", "q4": "zzz"}


@query(
    "ranked_batch",
    f"""WITH {_P}, q(query_id, term, n) AS (VALUES {', '.join(f"('{q}', '{t}', {n})" for q, s in _BATCH.items() for t, n in search.query_terms(s).items())}),
    s AS (SELECT query_id, doc_id, sum(tf * n)::DOUBLE AS score FROM p JOIN q USING (term) GROUP BY ALL), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) SELECT * FROM r WHERE rank <= 10""",
)
def ranked_batch(spark, d):
    return search.ranked_batch(_index(spark, d), _BATCH)


# ---- Boolean search ------------------------------------------------------------------------------------------------
_BOOLEAN = {
    "bool_and": ("the && of", "symbol", "list_contains(toks, 'the') AND list_contains(toks, 'of')"),
    "bool_or": ("la || und", "symbol", "list_contains(toks, 'la') OR list_contains(toks, 'und')"),
    "bool_not": ("!the", "symbol", "NOT list_contains(toks, 'the')"),
    "bool_nested": ("(the OR und) AND NOT la", "keyword", "(list_contains(toks, 'the') OR list_contains(toks, 'und')) AND NOT list_contains(toks, 'la')"),
    "bool_implicit_and": ("the of !(la || und)", "symbol", "list_contains(toks, 'the') AND list_contains(toks, 'of') AND NOT (list_contains(toks, 'la') OR list_contains(toks, 'und'))"),
    "bool_keyword_last_operand": ("the la", "keyword", "list_contains(toks, 'la')"),
    "bool_unknown_term": ("zzzz || !zzzy", "symbol", "list_contains(toks, 'zzzz') OR NOT list_contains(toks, 'zzzy')"),
    "bool_double_not": ("!!the", "symbol", "false"),
}


def _boolean(q: str, dialect: str) -> Query:
    return lambda spark, d: boolean.search(_index(spark, d), q, dialect, k=None)


for _name, (_q, _dialect, _where) in _BOOLEAN.items():
    query(_name, f"WITH {_T} SELECT doc_id, '' AS title, {_NAME.format('doc_id')} AS path FROM t WHERE {_where}")(_boolean(_q, _dialect))


@query("bool_first10", f"WITH {_T} SELECT doc_id, '' AS title, {_NAME.format('doc_id')} AS path FROM t WHERE list_contains(toks, 'the') ORDER BY doc_id LIMIT 10")
def bool_first10(spark, d):
    return boolean.search(_index(spark, d), "the")


@query("bool_page2", f"WITH {_T} SELECT doc_id, '' AS title, {_NAME.format('doc_id')} AS path FROM t WHERE list_contains(toks, 'the') ORDER BY doc_id LIMIT 50 OFFSET 50")
def bool_page2(spark, d):
    return boolean.search_page(_index(spark, d), "the", "2")[0]


# ---- rank and frequency --------------------------------------------------------------------------------------------
_R = f"WITH {_P}, f AS (SELECT term, sum(tf)::BIGINT AS real_freq FROM p GROUP BY term), r AS (SELECT real_freq, row_number() OVER (ORDER BY real_freq DESC, term) AS rank FROM f), z AS (SELECT count(*) AS terms, -regr_slope(ln(real_freq), ln(rank)) AS s, exp(regr_intercept(ln(real_freq), ln(rank))) AS c_fit, max(real_freq) AS c FROM r)"


@query("zipf_rank_table", f"{_R} SELECT rank, real_freq, c / rank AS zipf_ideal, round(c_fit / pow(rank, s), 6) AS zipf_fit FROM r, z")
def zipf_rank_table(spark, d):
    return zipf.table(_terms(spark, d)).withColumn("zipf_fit", F.round("zipf_fit", 6))


@query("zipf_fit", f"{_R} SELECT terms, round(s, 8) AS s, round(c_fit, 4) AS c_fit, c FROM z")
def zipf_fit(spark, d):
    return zipf.fit(_terms(spark, d)).withColumns({"s": F.round("s", 8), "c_fit": F.round("c_fit", 4)})


@query("rank_csv_roundtrip", f"{_R} SELECT rank, real_freq, round(c / rank, 6) AS zipf_ideal, round(c_fit / pow(rank, s), 6) AS zipf_fit FROM r, z")
def rank_csv_roundtrip(spark, d):
    at = new_path(spark, "ranks")
    writers.write_rank_table(zipf.table(_terms(spark, d)), at)
    back = spark.read.schema("rank long, real_freq long, zipf_ideal double, zipf_fit double").option("header", "true").csv(at)
    return back.withColumns({c: F.round(c, 6) for c in ("zipf_ideal", "zipf_fit")})


# ---- URLs and links ------------------------------------------------------------------------------------------------
def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def _norm(u: str) -> str:
    bare = rf"regexp_replace(regexp_replace(coalesce({u}, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '(?s)[#?].*$', '')"
    part = lambda i: f"regexp_extract({bare}, '(?is)^(https?)://([^/]*)(.*)$', {i})"
    tail = f"CASE WHEN {part(3)} = '' THEN '/' ELSE regexp_replace({part(3)}, '(?s)(.)/$', '\\1') END"
    return f"CASE WHEN {part(2)} = '' THEN '' ELSE lower({part(1)}) || '://' || lower({part(2)}) || {tail} END"


_HOST = "lower(regexp_extract({0}, '(?is)^(https?)://([^/]*)', 2))"
_PATH = "CASE WHEN regexp_extract({0}, '(?is)^(https?)://([^/]*)(.*)$', 3) = '' THEN '/' ELSE regexp_extract({0}, '(?is)^(https?)://([^/]*)(.*)$', 3) END"
_ALLOWED = "(" + " OR ".join(f"{_HOST} = '{x}' OR ends_with({_HOST}, '.{x}')" for x in DOMAINS) + ")"
_USEFUL = f"({{0}} <> '' AND strlen({{0}}) <= {U.MOST_BYTES} AND NOT ends_with(lower({_PATH}), '.pdf') AND NOT regexp_matches(lower({_PATH}), '^/({'|'.join(U.USELESS_PREFIXES)})')" + "".join(f" AND NOT contains(lower({_PATH}), '{x}')" for x in U.USELESS_PARTS) + ")"


@query("url_normalize", f"SELECT page_id, {_norm('url')} AS normalized FROM pages")
def url_normalize(spark, d):
    return _pages(spark, d).select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


@query("url_host_path", f"SELECT page_id, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM pages")
def url_host_path(spark, d):
    return _pages(spark, d).select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))


@query("url_filter", f"SELECT page_id, {_ALLOWED.format('url')} AS allowed, {_USEFUL.format('url')} AS useful FROM pages")
def url_filter(spark, d):
    return _pages(spark, d).select("page_id", U.is_allowed_domain(F.col("url"), DOMAINS).alias("allowed"), U.is_useful_url(F.col("url")).alias("useful"))


@query("html_preview", "SELECT page_id, substring(html, 1, 300) AS preview, md5(html) AS content_hash FROM pages")
def html_preview(spark, d):
    return _pages(spark, d).select("page_id", T.preview(F.col("html")).alias("preview"), U.content_hash(F.col("html")).alias("content_hash"))


@query("html_escape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')) AS escaped_md5 FROM pages""")
def html_escape(spark, d):
    return _pages(spark, d).select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped_md5"))


_ORIGIN = "regexp_extract({0}, '(?i)^(https?://[^/?#]*)', 1)"


@query(
    "url_join",
    f"""WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN {_ORIGIN.format('url')} || '/p/' || page_id || '?x=1#y' WHEN 1 THEN 'HTTPS://Other.org/q/' || page_id || '/' WHEN 2 THEN 'http://Third.org/r' END AS joined FROM pages)
    SELECT page_id, {_norm('joined')} AS joined FROM h""",
)
def url_join(spark, d):
    """A path, an address, one without its scheme's case, and no link at all, from each page."""
    i = F.col("page_id")
    href = F.when(i % 4 == 0, F.concat(F.lit(" /p/"), i, F.lit("?x=1#y"))).when(i % 4 == 1, F.concat(F.lit("HTTPS://Other.org/q/"), i, F.lit("/"))).when(i % 4 == 2, F.lit("http://Third.org/r"))
    return _pages(spark, d).select("page_id", U.join_url(spark, F.col("url"), href).alias("joined"))


@query("header_values", "SELECT page_id, '\"' || page_id || '\"' AS etag, CASE WHEN page_id % 2 = 0 THEN 'Text/HTML' ELSE '' END AS content_type, '' AS last_modified FROM pages")
def header_values(spark, d):
    i = F.col("page_id").cast("string")
    block = F.concat(F.lit('HTTP/1.1 200 OK\r\nETAG: "old"\r\neTag:  "'), i, F.lit('"  \r\nX-ETag: no\r\n'), F.when(F.col("page_id") % 2 == 0, "Content-Type: Text/HTML\r\n").otherwise(""))
    return _pages(spark, d).select("page_id", *[U.header(block, name).alias(name.replace("-", "_")) for name in ("etag", "content-type", "last-modified")])


_HREFS = """unnest(regexp_extract_all(html, '(?i)<a[ ][^>]*href="([^"]*)"', 1))"""


def _links_sql(pages: str, page: str) -> str:
    """Links of pages whose hrefs are paths, as those of the tables are."""
    return f"""h AS (SELECT {page} AS page, url, {_HREFS} AS href FROM {pages}), l AS (SELECT DISTINCT page, {_norm(_ORIGIN.format('url') + ' || href')} AS link FROM h), k AS (SELECT * FROM l WHERE {_ALLOWED.format('link')} AND {_USEFUL.format('link')})"""


@query("extract_links", f"WITH {_links_sql('pages', 'page_id')} SELECT page AS page_id, row_number() OVER (PARTITION BY page ORDER BY link) - 1 AS nth, link FROM k")
def extract_links(spark, d):
    links = _pages(spark, d).select("page_id", F.posexplode(U.extract_links(spark, F.col("url"), F.col("html"), DOMAINS)).alias("nth", "link"))
    return links.withColumn("nth", F.col("nth").cast("long"))


@query("links_distinct", f"WITH {_links_sql('pages', 'page_id')} SELECT link, count(*) AS pages FROM k GROUP BY link")
def links_distinct(spark, d):
    links = _pages(spark, d).select(F.explode(U.extract_links(spark, F.col("url"), F.col("html"), DOMAINS)).alias("link"))
    return links.groupBy("link").agg(F.count(F.lit(1)).alias("pages"))


# ---- crawl ---------------------------------------------------------------------------------------------------------
def _frontier(spark, d):
    """The pages' addresses as a frontier in all states: by page_id, as the SQL twin has it."""
    p = _pages(spark, d).select(U.normalize_url(F.col("url")).alias("url"), "page_id").groupBy("url").agg(F.min("page_id").alias("i"))
    i = F.col("i")
    return p.where("url <> ''").select(
        "url",
        F.when(i % 7 == 0, "in_progress").when(i % 5 == 0, "done").when(i % 3 == 0, "failed").otherwise("pending").alias("status"),
        F.lit(None).cast("string").alias("discovered_from"),
        (i % 4).alias("fail_count"),
        F.lit(None).cast("long").alias("last_crawled_at"),
        (F.lit(NOW) + i % 11 - 5).cast("long").alias("next_crawl_at"),
        (F.lit(NOW - 1000) + i % 13).cast("long").alias("created_at"),
        F.lit(None).cast("long").alias("picked_at"),
    )


_FRONTIER = f"""u AS (SELECT {_norm('url')} AS url, page_id FROM pages), g AS (SELECT url, min(page_id) AS i FROM u WHERE url <> '' GROUP BY url),
fr AS (SELECT url, CASE WHEN i % 7 = 0 THEN 'in_progress' WHEN i % 5 = 0 THEN 'done' WHEN i % 3 = 0 THEN 'failed' ELSE 'pending' END AS status, NULL::VARCHAR AS discovered_from, i % 4 AS fail_count,
  NULL::BIGINT AS last_crawled_at, {NOW} + i % 11 - 5 AS next_crawl_at, {NOW - 1000} + i % 13 AS created_at, NULL::BIGINT AS picked_at FROM g)"""


@query("frontier_seed", f"WITH u AS (SELECT DISTINCT {_norm('url')} AS url FROM pages) SELECT url, 'pending' AS status, NULL::VARCHAR AS discovered_from, 0::BIGINT AS fail_count, NULL::BIGINT AS last_crawled_at, {NOW}::BIGINT AS next_crawl_at, {NOW}::BIGINT AS created_at, NULL::BIGINT AS picked_at FROM u WHERE {_ALLOWED.format('url')} AND {_USEFUL.format('url')}")
def frontier_seed(spark, d):
    return crawl.seed(crawl.empty(spark, crawl.FRONTIER), _pages(spark, d), DOMAINS, NOW)


@query("frontier_reset", f"WITH {_FRONTIER} SELECT url, CASE WHEN status = 'in_progress' THEN 'pending' ELSE status END AS status FROM fr")
def frontier_reset(spark, d):
    return crawl.reset_stale(_frontier(spark, d)).select("url", "status")


@query("frontier_pick", f"WITH {_FRONTIER}, c AS (SELECT url FROM fr WHERE status IN ('pending', 'done', 'failed') AND next_crawl_at <= {NOW} ORDER BY next_crawl_at, created_at, url LIMIT 20) SELECT fr.url, CASE WHEN c.url IS NULL THEN status ELSE 'in_progress' END AS status, CASE WHEN c.url IS NULL THEN 0 ELSE {NOW} END::BIGINT AS picked_at FROM fr LEFT JOIN c ON c.url = fr.url")
def frontier_pick(spark, d):
    return crawl.pick(_frontier(spark, d), NOW, 20)[0].select("url", "status", F.coalesce("picked_at", F.lit(0)).alias("picked_at"))


@query("frontier_status_stats", f"WITH {_FRONTIER} SELECT status, count(*) AS n FROM fr GROUP BY status")
def frontier_status_stats(spark, d):
    return crawl.status_counts(_frontier(spark, d))


@query("frontier_next_due", f"WITH {_FRONTIER} SELECT url, status, next_crawl_at FROM fr ORDER BY next_crawl_at, url LIMIT 10")
def frontier_next_due(spark, d):
    return crawl.next_due(_frontier(spark, d)).select("url", "status", "next_crawl_at")


def _round(spark, d):
    """(documents, frontier, fetched): half of the pages are stored, some with another hash; results of every kind."""
    p = _pages(spark, d).withColumn("url", U.normalize_url(F.col("url"))).where("url <> ''")
    p = p.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("x")).select("url", F.col("x.page_id").alias("i"), F.col("x.html").alias("html"))
    i = F.col("i")
    fetched = p.select(
        "url",
        F.when(i % 11 == 0, 404).when(i % 13 == 0, 304).otherwise(200).cast("long").alias("status_code"),
        F.col("html").alias("body"),
        F.when(i % 17 == 0, "Application/PDF").otherwise("Text/HTML; charset=utf-8").alias("content_type"),
        F.concat(F.lit("e"), i).alias("etag"),
        F.lit("").alias("last_modified"),
        (i % 19 == 0).alias("too_large"),
        (i % 23 == 0).alias("request_failed"),
    )
    stored = p.where(i % 2 == 0).select("url", F.when(i % 4 == 0, F.col("html")).otherwise("old").alias("html"), U.host(F.col("url")).alias("source"), F.lit(NOW - 90000).cast("long").alias("crawl_timestamp"), F.lit("old").alias("etag"), F.lit("").alias("last_modified"), F.md5(F.when(i % 4 == 0, F.col("html")).otherwise("old")).alias("content_hash"), F.lit(200).cast("long").alias("status_code"))
    return stored, _frontier(spark, d), fetched


_ROUND = f"""{_FRONTIER}, pg AS (SELECT url, arg_min(html, page_id) AS html, min(page_id) AS i FROM (SELECT {_norm('url')} AS url, page_id, html FROM pages) WHERE url <> '' GROUP BY url),
st AS (SELECT url, CASE WHEN i % 4 = 0 THEN html ELSE 'old' END AS html FROM pg WHERE i % 2 = 0),
oc AS (SELECT pg.url, pg.i, pg.html, CASE WHEN i % 23 = 0 THEN 'failed_request' WHEN i % 11 = 0 THEN 'failed_http_404' WHEN i % 13 = 0 THEN 'not_modified' WHEN i % 17 = 0 THEN 'skipped_content_type_application/pdf'
  WHEN i % 19 = 0 OR strlen(pg.html) > {CONFIG.max_html_bytes} THEN 'skipped_too_large' WHEN st.html IS NOT NULL AND md5(st.html) = md5(pg.html) THEN 'unchanged' ELSE 'changed' END AS outcome FROM pg LEFT JOIN st ON st.url = pg.url)"""


@query("crawl_outcome", f"WITH {_ROUND} SELECT url, outcome FROM oc")
def crawl_outcome(spark, d):
    documents, frontier, fetched = _round(spark, d)
    return crawl.outcomes(fetched, documents, CONFIG).select("url", "outcome")


@query(
    "document_upsert",
    f"""WITH {_ROUND}, n AS (SELECT * FROM oc WHERE outcome IN ('changed', 'unchanged'))
    SELECT coalesce(st.url, n.url) AS url, md5(CASE WHEN outcome = 'changed' THEN n.html ELSE st.html END) AS html_md5, {_HOST.format('coalesce(st.url, n.url)')} AS source,
    CASE WHEN outcome IS NULL THEN {NOW - 90000} ELSE {NOW} END::BIGINT AS crawl_timestamp, CASE WHEN outcome IS NULL THEN 'old' ELSE 'e' || i END AS etag, '' AS last_modified,
    md5(CASE WHEN outcome = 'changed' THEN n.html ELSE st.html END) AS content_hash, 200::BIGINT AS status_code FROM st FULL OUTER JOIN n ON n.url = st.url""",
)
def document_upsert(spark, d):
    documents, frontier, fetched = _round(spark, d)
    out = crawl.upsert_documents(documents, crawl.outcomes(fetched, documents, CONFIG), NOW)
    return out.withColumn("html_md5", F.md5("html")).drop("html")


@query(
    "frontier_after_round",
    f"""WITH {_ROUND} SELECT fr.url, CASE WHEN outcome IN ('changed', 'unchanged', 'not_modified') THEN 'done' ELSE 'failed' END AS status,
    fail_count + CASE WHEN outcome IN ('changed', 'unchanged', 'not_modified') THEN 0 ELSE 1 END AS fail_count, {NOW}::BIGINT AS last_crawled_at, {NOW + CONFIG.recrawl_interval_seconds}::BIGINT AS next_crawl_at FROM fr JOIN oc ON oc.url = fr.url""",
)
def frontier_after_round(spark, d):
    documents, frontier, fetched = _round(spark, d)
    out = crawl.mark(frontier, crawl.outcomes(fetched, documents, CONFIG), CONFIG, NOW)
    return out.select("url", "status", "fail_count", "last_crawled_at", "next_crawl_at")


@query(
    "frontier_with_links",
    f"""WITH {_ROUND}, seen AS (SELECT * FROM oc WHERE outcome IN ('changed', 'unchanged')), {_links_sql('seen', 'url')}
    SELECT fr.url, CASE WHEN outcome IN ('changed', 'unchanged', 'not_modified') THEN 'done' ELSE 'failed' END AS status, NULL::VARCHAR AS discovered_from, fail_count + CASE WHEN outcome IN ('changed', 'unchanged', 'not_modified') THEN 0 ELSE 1 END AS fail_count,
      {NOW}::BIGINT AS last_crawled_at, {NOW + CONFIG.recrawl_interval_seconds}::BIGINT AS next_crawl_at, created_at, 0::BIGINT AS picked_at FROM fr JOIN oc ON oc.url = fr.url
    UNION ALL SELECT link, 'pending', min(page), 0, 0, {NOW}, {NOW}, 0 FROM k WHERE link NOT IN (SELECT url FROM fr) GROUP BY link""",
)
def frontier_with_links(spark, d):
    documents, frontier, fetched = _round(spark, d)
    return crawl.apply_fetch(documents, frontier, fetched, CONFIG, NOW)[1].na.fill(0, ["last_crawled_at", "picked_at"])


@query("crawl_conditional", f"WITH {_ROUND} SELECT fr.url, CASE WHEN st.url IS NULL THEN '' ELSE 'old' END AS etag, '' AS last_modified FROM fr LEFT JOIN st ON st.url = fr.url")
def crawl_conditional(spark, d):
    documents, frontier, _ = _round(spark, d)
    return crawl.conditional(frontier, documents)


@query(
    "crawl_loop",
    f"""WITH u AS (SELECT {_norm('url')} AS url, min(page_id) AS i FROM pages GROUP BY 1), s AS (SELECT * FROM u WHERE {_ALLOWED.format('url')} AND {_USEFUL.format('url')} ORDER BY url LIMIT 25)
    SELECT url, 'body ' || i AS html, {_HOST.format('url')} AS source, {NOW}::BIGINT AS crawl_timestamp, 200::BIGINT AS status_code FROM s""",
)
def crawl_loop(spark, d):
    """Rounds of ten pages, 25 in all, over all allowed pages."""
    table = _pages(spark, d).groupBy(U.normalize_url(F.col("url")).alias("url")).agg(F.min("page_id").alias("i"))
    none = F.lit("")

    def fetch(asked: DataFrame) -> DataFrame:
        return asked.select("url").join(table, "url").select("url", F.lit(200).cast("long").alias("status_code"), F.concat(F.lit("body "), "i").alias("body"), F.lit("text/html").alias("content_type"), none.alias("etag"), none.alias("last_modified"), F.lit(False).alias("too_large"), F.lit(False).alias("request_failed"))

    frontier = crawl.seed(crawl.empty(spark, crawl.FRONTIER), _pages(spark, d), DOMAINS, NOW)
    documents, _ = crawl.crawl(crawl.empty(spark, crawl.DOCUMENTS), frontier, fetch, crawl.Config(DOMAINS, max_pages_per_run=25), NOW, 10)
    return documents.select("url", "html", "source", "crawl_timestamp", "status_code")


_CONFIG = """db:
  path: "crawl.db"  # where it is kept

logic:
  crawl_delay_seconds: 2
  recrawl_interval_seconds: 3600
  request_timeout_seconds: 9
  max_pages_per_run: 7
  max_html_bytes: 1000
  user_agent: "Agent/1.0"
  allowed_domains:
    - "example.com"
    - example.org
  seed_urls:
    - "https://example.com/#top"
  seed_urls_file: ""
"""


@query(
    "crawl_config",
    "SELECT * FROM (VALUES ('db_path', 'crawl.db'), ('crawl_delay_seconds', '2'), ('recrawl_interval_seconds', '3600'), ('request_timeout_seconds', '9'), ('max_pages_per_run', '7'), ('max_html_bytes', '1000'), ('user_agent', 'Agent/1.0'), ('allowed_domains', 'example.com,example.org'), ('seed_urls', 'https://example.com/#top'), ('seed_urls_file', '')) AS t(key, value)",
)
def crawl_config(spark, d):
    with tempfile.TemporaryDirectory() as at:
        (Path(at) / "config.yaml").write_text(_CONFIG, encoding="utf-8")
        found = asdict(readers.read_config(f"{at}/config.yaml"))
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, (list, tuple)) else str(v)) for k, v in found.items()], "key string, value string")


@query("crawl_summary", f"WITH {_ROUND} SELECT 'documents' AS name, count(*) AS n FROM st UNION ALL SELECT 'frontier', count(*) FROM fr UNION ALL SELECT 'frontier_' || status, count(*) FROM fr GROUP BY status")
def crawl_summary(spark, d):
    documents, frontier, _ = _round(spark, d)
    return crawl.summary(documents, frontier)


@query("newest_documents", f"WITH {_ROUND} SELECT url, {NOW - 90000}::BIGINT AS crawl_timestamp FROM st ORDER BY url LIMIT 10")
def newest_documents(spark, d):
    return crawl.newest_documents(_round(spark, d)[0]).select("url", "crawl_timestamp")


# ---- stemming, events ----------------------------------------------------------------------------------------------
# Published vectors of words and stems.
PORTER = (
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
    ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"),
    ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"),
    ("hopefulness", "hope"), ("triplicate", "triplic"), ("formalize", "formal"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustable", "adjust"), ("replacement", "replac"),
    ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil"),
)


@query("porter_vectors", f"SELECT * FROM (VALUES {', '.join(map(repr, PORTER))}) AS t(term, stem)")
def porter_vectors(spark, d):
    words = spark.createDataFrame([(w,) for w, _ in PORTER], "term string")
    return words.select("term", F.when(T.may_stem(F.col("term")), stem_column(spark)("term")).otherwise(F.col("term")).alias("stem"))


@query("porter_stem_vocab")
def porter_stem_vocab(spark, d):
    terms = _terms(spark, d).select("term")
    return terms.select("term", F.when(T.may_stem(F.col("term")), stem_column(spark)("term")).otherwise(F.col("term")).alias("stem"))


@query("events_hourly", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly(spark, d):
    return ingest.event_counts(spark.read.parquet(f"{d}/events.parquet")).withColumn("total", F.round("total", 4))
