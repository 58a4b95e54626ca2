"""Queries over a store that is filled from the table of documents: chunks, index, files, lifecycle."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.blocks import work_dir
from lakesift.functions import text as tx
from lakesift.operators import chunking, fulltext, ingest, lifecycle, retrieval, search, statistics
from lakesift.plans.tables import table, texts
from lakesift.providers import HashingEmbedder
from lakesift.schema import Chunking, Settings
from lakesift.sources.files import read_files
from lakesift.store import Store
from lakesift.streaming.watch import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}
T, LATER = "2024-05-01 10:00:00", "2024-06-01 10:00:00"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: a folder for each source."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "text")
    return docs.select(F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("table:"), F.col("doc_id").cast("string")).alias("source_uri"), "text", F.lit(T).cast("timestamp").alias("modified_at"))


@lru_cache(maxsize=2)
def _added(spark: SparkSession, sf_dir: str, session: str) -> Store:
    store = Store(spark, work_dir(spark, "store"))
    ingest.add_documents(store, files(spark, sf_dir), "default", T)
    return store


def added(spark: SparkSession, sf_dir: str) -> Store:
    """A store with all documents, for what asks for no index: ``filled`` indexes the same store."""
    return _added(spark, sf_dir, spark.sparkContext.applicationId)


@lru_cache(maxsize=2)
def _filled(spark: SparkSession, sf_dir: str, session: str) -> Store:
    store = _added(spark, sf_dir, session)
    ingest.index_documents(store, HashingEmbedder(), Settings(), T)
    return store


def filled(spark: SparkSession, sf_dir: str) -> Store:
    """A store with all documents, indexed; filled once for each session and folder."""
    return _filled(spark, sf_dir, spark.sparkContext.applicationId)


# ------------------------------------------------------------------------------- chunks in SQL
_WS = "[ \\t\\n\\x0b\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_KINDS = {
    **{f"h{k}": ("\\n" + "#" * k + "([^#]|$)", w) for k, w in zip(range(1, 7), (100, 90, 80, 70, 60, 50), strict=True)}, "codeblock": ("\\n```", 65), "hr": (f"\\n(---|\\*\\*\\*|___){_WS}*\\n", 65),
    "sentence": (f"[.!?]{_WS}+[A-Z]", 30), "blank": ("\\n\\n", 20), "list": (f"\\n[-*]{_WS}", 5), "numlist": (f"\\n[0-9]+[.]{_WS}", 5), "newline": ("\\n", 1),
}
def _breaks_sql(source: str) -> str:
    """Every break of every different text of ``source`` (hash, text): hash, pl, kind, weight, guarded."""
    return f"""t AS (SELECT hash, text, length(text) AS n FROM ({source})),
 l AS (SELECT hash, generate_subscripts(cs, 1) - 1 AS pl, unnest(cs) AS c FROM (SELECT hash, string_split(text, '') AS cs FROM t)),
 s AS (SELECT l.hash, pl, c, text, substr(text, pl + 1, 400) AS tail, CASE WHEN c = chr(10) THEN lag(pl) OVER (PARTITION BY l.hash, c = chr(10) ORDER BY pl) END AS line, substr(text, pl, 1) AS before FROM l JOIN t ON l.hash = t.hash WHERE c IN (chr(10), '.', '!', '?')),
 k AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(tail, '^{p}')" + (" AND before <> chr(10)" if k == "blank" else "") + f" THEN '{k}'" for k, (p, _) in _KINDS.items())} END AS kind FROM s),
 br AS (SELECT hash, pl, kind, CASE kind {' '.join(f"WHEN '{k}' THEN {w}" for k, (_, w) in _KINDS.items())} END AS weight,
  coalesce(sum((kind = 'codeblock')::INT) OVER (PARTITION BY hash ORDER BY pl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 OR (c = chr(10) AND substr(text, coalesce(line + 1, 0) + 1, 1) = '|') AS guarded FROM k WHERE kind IS NOT NULL)"""


def _chunks_sql(source: str, target: int = 2100, overlap: int = 225, least: int = 100) -> str:
    """Every chunk of every different text of ``source``: hash, seq, pos, stop, text. Each step of the recursion cuts one chunk of each text."""
    best = f"CASE WHEN {{b}} + {target} >= n THEN n ELSE coalesce(-list_aggregate(list_transform(list_filter(bs, lambda x: x.pl > greatest({{b}}, {{a}}) AND x.pl < {{b}} + {target}), lambda x: {{{{'v': x.w::DOUBLE * (1::DOUBLE - (({{b}} + {target} - x.pl)::DOUBLE / {target}::DOUBLE) * (({{b}} + {target} - x.pl)::DOUBLE / {target}::DOUBLE) * 0.7::DOUBLE), 'a': -x.pl}}}}), 'max').a, {{b}} + {target}) END"
    kept = f"CASE WHEN stop - pos >= {least} THEN pos ELSE kept END"
    tail = f"substr(text, stop - {overlap - 1}, {overlap})"
    return f"""WITH RECURSIVE {_breaks_sql(source)},
 d AS (SELECT t.hash, any_value(text) AS text, any_value(n) AS n, coalesce(list({{'pl': pl, 'w': weight}}) FILTER (pl IS NOT NULL AND NOT guarded), []) AS bs FROM t LEFT JOIN br ON t.hash = br.hash GROUP BY t.hash),
 c AS (SELECT hash, 0 AS k, 0::BIGINT AS pos, 0::BIGINT AS kept, {best.format(b='0::BIGINT', a='0::BIGINT')} AS stop FROM d WHERE n > 0
  UNION ALL SELECT hash, k + 1, pos, kept, {best.format(b='pos', a='after')} FROM (
   SELECT d.hash, k, n, bs, stop AS after, {kept} AS kept, CASE WHEN back > pos THEN back ELSE stop END AS pos FROM (
    SELECT c.*, CASE WHEN stop - {overlap} > {kept} THEN stop - {overlap} + coalesce(least(nullif(strpos({tail}, ' '), 0), nullif(strpos({tail}, chr(10)), 0)) - 1, {overlap}) ELSE stop END AS back
    FROM c JOIN d ON c.hash = d.hash WHERE c.pos + {target} < n) e JOIN d ON e.hash = d.hash) f),
 ch AS (SELECT c.hash, row_number() OVER (PARTITION BY c.hash ORDER BY k) - 1 AS seq, pos, stop, substr(text, pos + 1, stop - pos) AS text FROM c JOIN d ON c.hash = d.hash WHERE stop - pos >= {least})"""


_DOCUMENTS = "SELECT DISTINCT sha256(text) AS hash, text FROM documents"
_BREAKS, _CHUNKS = _breaks_sql(_DOCUMENTS), _chunks_sql(_DOCUMENTS)
_TOKENS = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda t: t <> '')"


@query(f"WITH {_BREAKS} SELECT doc_id, kind, count(*) AS n, sum(pl) AS places FROM documents JOIN br ON sha256(text) = hash GROUP BY 1, 2")
def break_type_counts(spark, sf_dir):
    """Breaks of each document by kind, as the chunker finds them."""
    found = chunking.break_rows(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query(_CHUNKS + " SELECT doc_id, seq, pos::INT AS pos, (stop - pos)::INT AS len, NULL::VARCHAR AS section_path, 'prose' AS chunk_type, NULL::VARCHAR AS language FROM documents d JOIN ch ON sha256(d.text) = hash")
def chunk_documents_default(spark, sf_dir):
    return chunking.chunk_documents(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").withColumn("seq", F.col("seq").cast("long"))


@query(_CHUNKS + " SELECT 'default/' || source || '/doc-' || doc_id || '.md' AS place, seq, sha256(ch.text) AS text_hash FROM documents d JOIN ch ON sha256(d.text) = hash")
def store_chunk_texts(spark, sf_dir):
    """Live chunks with every document that holds them, and their texts cut from the stored contents."""
    store = filled(spark, sf_dir)
    own = store.table("documents").where("active").select(F.col("hash").alias("content_hash"), F.concat_ws("/", "collection", "path").alias("place"))
    chunks = search.with_text(store, store.table("chunks").select("chunk_id"), store.table("chunks"))
    return chunks.join(own, "content_hash").select("place", F.col("seq").cast("long").alias("seq"), F.sha2("text", 256).alias("text_hash"))


@query(_CHUNKS + ", f AS (SELECT hash, min(doc_id) AS first FROM (SELECT sha256(text) AS hash, doc_id FROM documents) GROUP BY 1), o AS (SELECT DISTINCT hash FROM f) SELECT ch.hash AS content_hash, seq, count(*) AS n_documents FROM ch JOIN documents d ON sha256(d.text) = ch.hash GROUP BY 1, 2")
def store_live_chunks(spark, sf_dir):
    """Each live chunk once, with the number of documents that share it."""
    store = filled(spark, sf_dir)
    shared = store.table("documents").where("active").groupBy("hash").agg(F.count("*").alias("n_documents"))
    live = search.chunks_of(store)
    return live.join(shared, live.content_hash == shared.hash).select("content_hash", F.col("seq").cast("long").alias("seq"), "n_documents")


@query(_CHUNKS + f" SELECT hash AS content_hash, seq, len({_TOKENS.format('text')}) AS dl, 64 AS width, round(CASE WHEN len({_TOKENS.format('text')}) > 0 THEN 1 ELSE 0 END, 4)::DOUBLE AS norm FROM ch")
def store_index(spark, sf_dir):
    """What the index holds for each chunk: the number of its tokens, by the index and by the postings, and its vector."""
    store = filled(spark, sf_dir)
    vectors = store.table("vectors").select("chunk_id", F.size("embedding").alias("width"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4).alias("norm"))
    posted = store.table("postings").groupBy("chunk_id").agg(F.sum(F.size("positions")).alias("posted"))
    words = store.table("tokens").select("chunk_id", "dl").join(posted, "chunk_id", "left").where(F.col("dl") == F.coalesce("posted", F.lit(0)))
    return store.table("chunks").join(words, "chunk_id").join(vectors, "chunk_id").select("content_hash", F.col("seq").cast("long").alias("seq"), F.col("dl").cast("long").alias("dl"), "width", "norm")


@query(_CHUNKS + " SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM t) AS contents, count(*) AS chunks, (SELECT count(*) FROM t) AS indexed, 0 AS again FROM ch")
def index_documents(spark, sf_dir):
    """Rows of the store after indexing, and what is left to index: nothing."""
    store = filled(spark, sf_dir)
    again = ingest.index_documents(store, HashingEmbedder(), Settings(), T)["indexed"]
    counts = ingest.table_counts(spark, {n: store.table(n) for n in ("documents", "content", "chunks", "indexed")})
    return counts.agg(*[F.max(F.when(F.col("name") == n, F.col("n_rows"))).alias("contents" if n == "content" else n) for n in ("documents", "content", "chunks", "indexed")]).withColumn("again", F.lit(again))


class _Marked(HashingEmbedder):
    """The same model, but for a mark on what it gives: no vector of the other one has a component above 5."""

    def vectors(self, texts_: list[str]):
        return super().vectors(texts_) + 10


_EDIT = "substr({0}, 1, {1}) || ' more words here ' || substr({0}, {1} + 1)"
_EDITED = f"SELECT {_EDIT.format('text', '(length(text) // 2)')} AS text FROM documents WHERE doc_id % 4 = 0"


@query(_chunks_sql(f"SELECT DISTINCT sha256(text) AS hash, text FROM (SELECT text FROM documents UNION ALL {_EDITED})", 600, 60, 30)
       + f", was AS (SELECT DISTINCT sha256(ch.text) AS digest FROM ch WHERE hash IN (SELECT sha256(text) FROM documents)) SELECT ch.hash AS content_hash, seq, sha256(ch.text) NOT IN (SELECT digest FROM was) AS embedded FROM ch WHERE hash IN (SELECT sha256(text) FROM ({_EDITED})) AND hash NOT IN (SELECT sha256(text) FROM documents)")
def chunk_reuse(spark, sf_dir):
    """A quarter of the documents is edited in the middle and indexed again: which of their chunks the model was asked for."""
    store, own = Store(spark, work_dir(spark, "edited")), files(spark, sf_dir)
    settings = Settings(chunking=Chunking(600, 60, 30))
    ingest.add_documents(store, own, "default", T)
    ingest.index_documents(store, HashingEmbedder(), settings, T)
    number, half = F.regexp_extract("path", r"doc-(\d+)\.md", 1).cast("long"), F.floor(F.length("text") / 2).cast("int")
    edited = own.where(number % 4 == 0).withColumns({"text": F.concat(F.substring("text", F.lit(1), half), F.lit(" more words here "), F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")), "modified_at": F.lit(LATER).cast("timestamp")})
    ingest.add_documents(store, edited, "default", LATER)
    ingest.index_documents(store, _Marked(), settings, LATER)
    again = store.table("chunks").where(F.col("embedded_at") == F.lit(LATER).cast("timestamp"))
    return again.join(store.table("vectors"), "chunk_id").select("content_hash", F.col("seq").cast("long").alias("seq"), (F.array_max("embedding") > 5).alias("embedded"))


@query(_CHUNKS + " SELECT hash AS content_hash, seq, sha256(concat_ws(chr(10) || chr(10), lag(text) OVER w, text, lead(text) OVER w)) AS context_hash FROM ch WINDOW w AS (PARTITION BY hash ORDER BY seq)")
def chunk_context(spark, sf_dir):
    """Each chunk with its neighbours, by the join that search results take."""
    store = filled(spark, sf_dir)
    chunks = store.table("chunks")
    found = retrieval.with_context(chunks.select("content_hash", "seq"), chunks, store.table("content"))
    return found.select("content_hash", F.col("seq").cast("long").alias("seq"), F.sha2("context", 256).alias("context_hash"))


@query(_CHUNKS + f""", r AS (SELECT hash, seq, {_TOKENS.format('text')} AS tokens FROM ch), f AS (SELECT hash, seq, len(tokens) AS dl, len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'of' AND starts_with(tokens[i + 1], 'the'))) AS f0 FROM r),
 x AS (SELECT count(*) AS nr, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS n0 FROM f),
 z AS (SELECT hash, seq, CASE WHEN ln((nr - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((nr - n0 + 0.5) / (n0 + 0.5)) END * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS b FROM f, x WHERE f0 > 0)
 SELECT round(b, 6) AS raw_score, count(*) AS n FROM z GROUP BY 1""")
def search_index(spark, sf_dir):
    """Scores of all chunks for a phrase of words as they stand, found by their stems in the stored index: how many have each."""
    scored = statistics.unstemmed(filled(spark, sf_dir), fulltext.query("of the"))
    return scored.select(F.round(-F.col("raw_score"), 6).alias("raw_score")).groupBy("raw_score").agg(F.count("*").alias("n"))


_LEVEL = "floor(f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / 300.0)) * 8)::INT"


@query(_CHUNKS + f""", r AS (SELECT hash, seq, {_TOKENS.format('text')} AS tokens FROM ch), f AS (SELECT len(tokens) AS dl, len(list_filter(tokens, lambda t: t = 'und')) AS f0, len(list_filter(tokens, lambda t: t = 'que')) AS f1 FROM r),
 x AS (SELECT count(*) AS nr, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM f),
 z AS (SELECT greatest(ln((nr - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + greatest(ln((nr - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS b FROM f, x WHERE f0 > 0 OR f1 > 0)
 SELECT round(b, 6) AS raw_score, count(*) AS n FROM (SELECT b FROM z ORDER BY b DESC LIMIT 100) GROUP BY 1""")
def stored_best(spark, sf_dir):
    """The 100 best chunks for either of two words, from the stored counts and the high levels of their postings: how many have each score."""
    found = statistics.best(filled(spark, sf_dir), fulltext.query('"und" OR "que"', stemmed=True), 100)
    return found.select(F.round(-F.col("raw_score"), 6).alias("raw_score")).groupBy("raw_score").agg(F.count("*").alias("n"))


@query(_CHUNKS + f", r AS (SELECT {_TOKENS.format('text')} AS tokens FROM ch), f AS (SELECT len(tokens) AS dl, len(list_filter(tokens, lambda t: t = 'und')) AS f FROM r) SELECT 'und' AS term, {_LEVEL} AS level, count(*) AS n_docs, sum(f)::BIGINT AS n FROM f WHERE f > 0 GROUP BY 2 UNION ALL SELECT '', -1, count(*), sum(dl)::BIGINT FROM f")
def stored_counts(spark, sf_dir):
    """The stored counts of one word by level, and of all chunks."""
    own = filled(spark, sf_dir).table("statistics").where("term in ('und', '')")
    return own.groupBy("term", "level").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


@query("SELECT source || '/doc-' || doc_id || '.md' AS path, sha256(text) AS text_hash FROM documents WHERE doc_id % 10 = 7 AND source LIKE 'src1%' AND NOT starts_with(source, 'src12')")
def vault_files(spark, sf_dir):
    """The documents as files, written by tasks, and read again by a pattern with a folder, without those of an ignored folder."""
    folder = work_dir(spark, "vault")
    ingest.copy_to_vault(added(spark, sf_dir), "default", folder)
    found = read_files(spark, folder, "src1*/doc-*7.md", ["src12*"])
    return found.select("path", F.sha2("text", 256).alias("text_hash"))


@query("SELECT doc_id, source || ' ' || doc_id AS title, '{\"title\": \"' || source || ' ' || doc_id || '\", \"lang\": \"' || lang || '\", \"n\": ' || n_chars || '}' AS metadata FROM documents")
def front_matter(spark, sf_dir):
    """Title and metadata of documents with front matter."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    head = F.concat(F.lit("---\ntitle: "), "source", F.lit(" "), F.col("doc_id").cast("string"), F.lit("\nlang: "), "lang", F.lit("\nn: "), F.col("n_chars").cast("string"), F.lit("\n---\n"))
    return ingest.described(docs.select("doc_id", F.lit("x.md").alias("path"), F.concat(head, "text").alias("text"))).select("doc_id", "title", "metadata")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source IN ('src0', 'src5') AND doc_id % 28 >= 9")
def metadata_filter(spark, sf_dir):
    """Documents by values at paths of their front matter and the time of their last change."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    head = F.concat(F.lit("---\nlang: "), "lang", F.lit("\nfrom:\n  name: "), "source", F.lit("\ntags: [src0-or-5, "), F.when(F.col("source").isin("src0", "src5"), "yes").otherwise("no"), F.lit("]\n---\n"))
    day = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 28 as int))")
    told = ingest.described(docs.select("doc_id", F.lit("x.md").alias("path"), F.concat(head, "text").alias("text"), day.alias("modified_at")))
    found = search.Only(since="2024-01-10", fields=(("lang", "fr"), ("tags", "src0-or-5"))).documents(told)
    both = [search.Only(fields=(("from.name", name),)).documents(found) for name in ("src0", "src5")]
    return both[0].unionAll(both[1]).select("doc_id")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h0, sha256(text || CASE WHEN doc_id % 3 = 0 THEN ' again' ELSE '' END) AS h1, doc_id % 5 = 0 AS gone FROM documents),
 dead AS (SELECT DISTINCT h1 FROM d WHERE gone AND h1 NOT IN (SELECT h1 FROM d WHERE NOT gone))
SELECT * FROM (SELECT 'added' AS step, count(*) AS n FROM d UNION ALL SELECT 'updated', count(*) FILTER (doc_id % 3 = 0) FROM d UNION ALL SELECT 'unchanged', count(*) FILTER (doc_id % 3 <> 0) FROM d UNION ALL SELECT 'removed', count(*) FILTER (gone) FROM d
 UNION ALL SELECT 'purged', count(*) FILTER (gone) FROM d UNION ALL SELECT 'purged contents', (SELECT count(*) FROM dead) UNION ALL SELECT 'documents', count(*) FILTER (NOT gone) FROM d
 UNION ALL SELECT 'contents', count(DISTINCT h) FROM (SELECT h0 AS h FROM d UNION SELECT h1 FROM d) u WHERE h NOT IN (SELECT h1 FROM dead))""")
def store_lifecycle(spark, sf_dir):
    """Documents are added, a third of them changed, a fifth removed and purged: the counts of each step, and what is held then."""
    store = Store(spark, work_dir(spark, "lifecycle"))
    own = files(spark, sf_dir)
    number = F.regexp_extract("path", r"doc-(\d+)\.md", 1).cast("long")
    counts = {"added": ingest.add_documents(store, own, "default", T)["added"]}
    second = ingest.add_documents(store, own.withColumn("text", F.when(number % 3 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text"))), "default", T)
    counts |= {k: second[k] for k in ("updated", "unchanged")}
    counts["removed"] = ingest.remove_all(store, own.where(number % 5 == 0).select(F.lit("default").alias("collection"), "path"), T)
    counts["purged"], _, counts["purged contents"] = ingest.purge(store, LATER)
    counts["documents"], counts["contents"] = store.table("documents").count(), store.table("content").count()
    return spark.createDataFrame(list(counts.items()), "step string, n long")


@query("SELECT source AS name, '/data/' || source AS path, '**/*.md' AS pattern, count(*) FILTER (coalesce(quality, 1) = 1) AS n_documents FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def registry_list(spark, sf_dir):
    """The registry of collections with their active documents."""
    from lakesift.plans.tables import documents

    docs = documents(spark, sf_dir)
    held = docs.select(F.col("collection").alias("name")).distinct().select("name", F.concat(F.lit("/data/"), "name").alias("path"), F.lit("**/*.md").alias("pattern"), F.lit(True).alias("include_by_default"))
    return ingest.registry(held, docs).select("name", "path", "pattern", "n_documents")


@query("SELECT doc_id, seq, sha256(text) AS hash FROM (SELECT d.doc_id, text, unnest(range(0, greatest(1, (n_chars + 1874) // 1875))) AS seq FROM documents d) WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(quality, 1) = 1)")
def gc_chunks(spark, sf_dir):
    """Chunks of texts that no active document has any more."""
    from lakesift.plans.tables import documents

    docs = documents(spark, sf_dir)
    chunks = docs.select(F.col("id").alias("doc_id"), "hash", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.length("doc") / 1875)).cast("long") - 1)).alias("seq"))
    return lifecycle.unreferenced(chunks, docs.where("active")).select("doc_id", "seq", "hash")


#: Tags of pages as marks of Markdown: headings of four levels, lists, fences and tables.
_MARKS = [("<(script|style)[^>]*>.*?</(script|style)>", ""), ("<title>", "\n## "), ("<h1[^>]*>", "\n# "), ("<b>", "\n### "), ("<div[^>]*>", "\n#### "), ("<li>", "\n- "), ("<br>", "\n```text\n"), ("</p>", "\n```\n"), ("<nav>", "\n| row | of |\n"), ("<[^>]+>", "\n")]
_PAGES = "SELECT page_id AS hash, " + "regexp_replace(" * len(_MARKS) + "html" + "".join(f", '(?s){p}', '" + r.replace("\n", "' || chr(10) || '") + "', 'g')" for p, r in _MARKS) + " AS text FROM pages"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.col("html")
    for pattern, mark in _MARKS:
        md = F.regexp_replace(md, f"(?s){pattern}", mark)
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", md.alias("doc"))


_HEADS = """, hd AS (SELECT hash, len(regexp_extract(line, '^(#+)', 1)) AS level, regexp_extract(line, '^#{1,6}[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1) AS title, pl FROM (
  SELECT hash, line, sum(length(line) + 1) OVER (PARTITION BY hash ORDER BY k) - length(line) - 1 AS pl FROM (SELECT hash, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT hash, string_split(text, chr(10)) AS ls FROM t)))
  WHERE regexp_matches(line, '^#{1,6}[ \\t]+(.+?)[ \\t]*#*[ \\t]*$')),
 sp AS (SELECT ch.hash, seq, string_agg(coalesce(nullif(trim(substr(h.title, 1, greatest(0, ch.pos - h.pl - h.level - 1)::BIGINT), ' '), ''), h.title), ' > ' ORDER BY h.level) AS section_path FROM ch JOIN hd h ON ch.hash = h.hash AND h.pl < ch.pos
  WHERE NOT EXISTS (SELECT 1 FROM hd g WHERE g.hash = h.hash AND g.pl > h.pl AND g.pl < ch.pos AND g.level <= h.level) GROUP BY 1, 2),
 fl AS (SELECT hash, seq, sum(fence::INT) OVER (PARTITION BY hash, seq ORDER BY k) AS opened, fence, line FROM (SELECT hash, seq, generate_subscripts(ls, 1) AS k, unnest(ls) AS line, regexp_matches(unnest(ls), '^[ \\t]*```') AS fence FROM (SELECT hash, seq, string_split(text, chr(10)) AS ls FROM ch))),
 kd AS (SELECT hash, seq, bool_or(NOT fence AND opened % 2 = 1 AND regexp_matches(line, '\\S')) AS inside, bool_or(NOT fence AND opened % 2 = 0 AND regexp_matches(line, '\\S')) AS outside, max(CASE WHEN fence AND opened % 2 = 1 AND regexp_matches(line, '```.*\\w') THEN 'text' END) AS named FROM fl GROUP BY 1, 2)"""


@query(_chunks_sql(_PAGES, 300, 45, 30) + _HEADS + " SELECT ch.hash AS page_id, ch.seq, pos::INT AS pos, (stop - pos)::INT AS len, section_path, CASE WHEN NOT inside THEN 'prose' WHEN outside THEN 'mixed' ELSE 'code' END AS chunk_type, CASE WHEN inside THEN named END AS language FROM ch LEFT JOIN sp ON ch.hash = sp.hash AND ch.seq = sp.seq JOIN kd ON ch.hash = kd.hash AND ch.seq = kd.seq")
def section_paths(spark, sf_dir):
    """Chunks of pages as Markdown, with their headings of all levels, tables, and fences."""
    return chunking.chunk_documents(_pages(spark, sf_dir), "page_id", "doc", 300, 45, 30).withColumn("seq", F.col("seq").cast("long"))


@query(f"WITH {_breaks_sql(_PAGES)} SELECT hash AS page_id, count(*) AS n, count(*) FILTER (guarded) AS n_guarded, coalesce(sum(pl) FILTER (guarded), 0)::BIGINT AS places FROM br GROUP BY 1")
def fence_parity(spark, sf_dir):
    """Breaks of pages as Markdown, and those of them that lie inside a fence or a table."""
    found = chunking.break_rows(_pages(spark, sf_dir), "page_id", "doc")
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("guarded").alias("n_guarded"), F.sum(F.when(F.col("guarded"), F.col("pos")).otherwise(0)).cast("long").alias("places"))


@query("SELECT source || '/doc-' || doc_id || '.md' AS path, CASE WHEN doc_id % 4 = 0 THEN sha256(text || ' more') ELSE sha256(text) END AS hash, 'c' AS collection, n.added, n.updated, n.unchanged FROM documents, (SELECT count(*) AS added, count(*) FILTER (doc_id % 4 = 0) AS updated, count(*) FILTER (doc_id % 4 <> 0) AS unchanged FROM documents WHERE source LIKE 'src_') n WHERE source LIKE 'src_'")
def collection_update(spark, sf_dir):
    """A collection over a folder of files is read, a quarter of its files change, and it is read again: its documents, and what the readings counted."""
    folder = work_dir(spark, "collection")
    store = Store(spark, work_dir(spark, "collected"))
    first = Store(spark, work_dir(spark, "origin"))
    own = files(spark, sf_dir)
    ingest.add_documents(first, own, "default", T)
    ingest.copy_to_vault(first, "default", folder)
    ingest.register_collection(store, "c", folder, "src?/*.md", ignore=["*.txt"])
    added = ingest.update_collection(store, "c", T)["added"]
    number = F.regexp_extract("path", r"doc-(\d+)\.md", 1).cast("long")
    ingest.add_documents(first, own.where(number % 4 == 0).withColumn("text", F.concat("text", F.lit(" more"))), "default", LATER)
    ingest.copy_to_vault(first, "default", folder)
    again = ingest.update_collection(store, "c", LATER)
    counts = [F.lit(n).cast("long").alias(k) for k, n in (("added", added), ("updated", again["updated"]), ("unchanged", again["unchanged"]))]
    return store.table("documents").where("active").select("path", "hash", "collection", *counts)


@query(f"SELECT 'k' || key AS path, sha256(text) AS hash FROM (SELECT user_id AS key, event_type, coalesce(props, '') AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def watch_replay(spark, sf_dir):
    """The events as a log of changes, applied by a streaming query: the documents that are active then."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "added").otherwise("modified")
    log = e.select(F.lit("default").alias("collection"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), F.coalesce("props", F.lit("")).alias("text"), "ts", "event_id")
    folder = work_dir(spark, "changes")
    log.write.json(folder)
    store = Store(spark, work_dir(spark, "watched"))
    watch(spark, store, folder, work_dir(spark, "watch-checkpoint")).awaitTermination()
    return store.table("documents").where("active").select("path", "hash")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn * 604800 ELSE turn * 86400 END AS seconds FROM conversations")
def age_seconds(spark, sf_dir):
    """Seconds of ages such as 3d and 2w."""
    ages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("turn").cast("string"), F.when(F.col("role") == "user", "w").otherwise("d")).alias("age"))
    return ages.select("conv_id", "turn", tx.seconds_of(F.col("age")).alias("seconds"))


@query()
def full_pipeline(spark, sf_dir):
    """The staged search for all items of the benchmark, as one plan over the store: at most five results each, with their context."""
    store = filled(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = search.search_many(store, asked, HashingEmbedder(), count=5)
    return found.select("query_id", "place", "title", "section_path", "score", "bm25_rank", "vector_rank", F.sha2("excerpt", 256).alias("excerpt_hash"), F.sha2("context", 256).alias("context_hash"))
