"""Documents, chunks and hybrid search over `documents` and `embeddings`.

The title of a document is its first sentence; its vector is the embedding with its number, where there
is one. Query vectors are the mean vectors of the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import half_even
from ..functions.records import content_hash, json_record, sha1_key

from ..operators import search
from ..operators.ordering import literal_table
from ..session import pinned
from . import domain as D
from .cohort_queries import retention
from .registry import Tables, plan

TEXTS = (
    "The and attion to thanedble the, anea",
    "idiot clown loser",
    "En laleenéelle la des et",
    "Nicht aulich für sch erüver",
    "lorem ipsum dolor sit amet",
    "Ascirr para osóciónta cióngañ no",
    "In in oredble ea",
    "erver keit ungliche schtz",
    "Tion was thanonontioniner. Es.",
    "erreth was ofretihaou the that edouhe",
)
STOP = ("the", "and", "to", "in", "la", "des", "et", "en", "was", "no")
NONSENSE = 4


def texts(t: Tables) -> DataFrame:
    """The texts of the queries, without vectors."""
    return literal_table(t.spark, "query_id bigint, text string", list(enumerate(TEXTS)))


def queries(t: Tables) -> DataFrame:
    """One query per label: a fixed text and the mean vector of the label."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("vector"))
    asked = texts(t).join(rows, F.col("query_id") == F.col("label"), "left").drop("label")
    return pinned(asked.withColumn("vector", F.when(F.col("query_id") != NONSENSE, F.col("vector"))))


def title():
    """The title of a document is its first sentence; texts are searched whole."""
    return F.regexp_extract("text", r"^([^.\n]*)", 1)


_CENTROIDS = f"""parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
), means AS (SELECT label, i, avg(x::DOUBLE) AS m FROM parts GROUP BY ALL
), centroids AS (SELECT label AS query_id, list(m ORDER BY i) AS c FROM means WHERE label <> {NONSENSE} GROUP BY 1
), scored AS (SELECT query_id, vec_id AS id, round_even(list_cosine_similarity(embedding::DOUBLE[], c) * 1e9, 0) / 1e9 AS similarity
  FROM embeddings CROSS JOIN centroids
), vectors AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS position FROM scored QUALIFY position <= 30)"""


_ASKED = "VALUES " + ", ".join(f"({i}, '{text}')" for i, text in enumerate(TEXTS))
_STOPS = ", ".join(f"'{w}'" for w in STOP)


_WORDS = r"string_split_regex(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+')"
def _coverage(asked: str) -> str:
    return f"""texts_asked(query_id, text) AS ({asked}
), terms_asked AS (SELECT query_id, list_filter(list_distinct({_WORDS.format("text")}), lambda w: w <> '' AND w NOT IN ({_STOPS})) AS terms FROM texts_asked
), asked AS (SELECT query_id, terms, greatest(1, ceil(len(terms) * 0.5)) AS needed FROM terms_asked WHERE len(terms) > 0
), words AS (SELECT doc_id AS id, {_WORDS.format("text")} AS w FROM documents
), covered AS (SELECT query_id, id, len(list_intersect(list_distinct(w), terms)) AS covered, len(list_filter(w, lambda x: list_contains(terms, x))) AS hits, needed
  FROM words CROSS JOIN asked
), texts AS (SELECT query_id, id, covered, hits, row_number() OVER (PARTITION BY query_id ORDER BY covered DESC, hits DESC, id) AS position
  FROM covered WHERE covered >= needed)"""


_COVERAGE = _coverage(_ASKED)


def _grams(text: str, fold: bool = False) -> str:
    inner = f"strip_accents({text})" if fold else text
    return (
        r"flatten(list_transform(list_filter(string_split_regex(lower(" + inner + r"), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0), "
        r"lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
    )


def _titles(asked: str) -> str:
    return f"""spelled(query_id, text) AS ({asked}
), forms AS (SELECT query_id, text AS form FROM spelled UNION SELECT query_id, strip_accents(text) FROM spelled
), f AS (SELECT query_id, form, list_distinct({_grams("form")}) AS q FROM forms
), t AS (SELECT doc_id AS id, regexp_extract(text, '^([^.\\n]*)', 1) AS title, {_grams("regexp_extract(text, '^([^.\\n]*)', 1)")} AS g FROM documents
), bounded AS (SELECT * FROM t CROSS JOIN f WHERE len(list_intersect(q, list_distinct(g))) / len(q) >= 0.8
), placed AS (SELECT *, list_filter(range(1, len(g) + 1), lambda i: list_contains(q, g[i])) AS p FROM bounded
), runs AS (SELECT query_id, id, contains(lower(title), lower(form)) AS inside, g, q, unnest(p) AS a, p FROM placed
), ends AS (SELECT query_id, id, inside, g, q, a, unnest(list_filter(p, lambda b: b >= a)) AS b FROM runs
), sims AS (SELECT query_id, id, inside, len(list_intersect(list_distinct(g[a:b]), q)) AS s, len(list_distinct(g[a:b])) AS n, len(q) AS m FROM ends
), best AS (SELECT query_id, id, bool_or(inside) AS contains, max(s / (m + n - s)) AS similarity FROM sims GROUP BY ALL
), titles AS (SELECT *, contains OR similarity >= 0.99 AS exact, row_number() OVER (PARTITION BY query_id ORDER BY contains DESC, similarity DESC, id) AS position
  FROM best WHERE similarity >= 0.8)"""


_TITLES = _titles(_ASKED)


def _fused(vectors: str, asked: str) -> str:
    return f"""{vectors}, {_coverage(asked)}, {_titles(asked)}, held AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS position
  FROM scored WHERE id IN (SELECT doc_id FROM documents) QUALIFY position <= 30
), lists AS (
  SELECT query_id, id, 1.0::DOUBLE / (60 + position) AS score, similarity >= 0.55 AS strong, similarity >= 0.45 AS near, false AS exact, similarity FROM held
  UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + position), true, false, false, 0 FROM texts
  UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + position), true, false, exact, 0 FROM titles
), fused AS (SELECT query_id, id, sum(CAST(score AS DECIMAL(20,15)))::DOUBLE + CASE WHEN bool_or(exact) THEN 1.0::DOUBLE / 61 ELSE 0 END AS relevance,
    bool_or(strong) AS strong, bool_or(near) AS near, max(similarity) AS similarity FROM lists GROUP BY ALL
), gated AS (SELECT query_id, id, round_even(relevance * 1e9, 0) / 1e9 AS relevance, similarity
  FROM fused JOIN (SELECT query_id, bool_or(strong) AS evidence FROM fused GROUP BY 1) USING (query_id) WHERE strong OR (near AND evidence)
), one AS (SELECT g.*, CASE WHEN doc_id % 3 <> 0 THEN source END AS file FROM gated g JOIN documents d ON d.doc_id = g.id
  QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(file, id::VARCHAR) ORDER BY relevance DESC, similarity DESC, id) = 1
), hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, similarity DESC, id) AS position FROM one QUALIFY position <= 5)"""


_FUSED = _fused(_CENTROIDS, _ASKED)


@plan("string kind key title content", "J01 J02",
      f"""WITH {D.RISK}, titles AS (SELECT lower(split_part(text, chr(10), 1)) AS title, lang, source, count(*) AS plans FROM documents
        WHERE split_part(text, chr(10), 1) <> '' GROUP BY ALL)
      SELECT 'curso' AS kind, course AS key, course AS title, '{{"course":"' || course || '","risk_class":"' || risk_class || '","total":' || total || '}}' AS content FROM retention
      UNION ALL SELECT 'projeto', sha1(title || '|' || lang || '|' || source), title, '{{"lang":"' || lang || '","plans":' || plans || '}}' FROM titles""")
def build_documents(t: Tables) -> DataFrame:
    """A document per programme, and one per distinct title; here a title is a text's first line."""
    courses = retention(t).select(
        F.lit("curso").alias("kind"), F.col("course").alias("key"), F.col("course").alias("title"),
        json_record(F.col("course"), F.col("risk_class"), F.col("total")).alias("content"),
    )
    titled = t.documents.withColumn("title", F.lower(F.split("text", "\n", 2)[0])).filter("title <> ''")
    projects = titled.groupBy("title", "lang", "source").agg(F.count("*").alias("plans"))
    return courses.unionByName(projects.select(
        F.lit("projeto").alias("kind"), sha1_key(F.col("title"), F.col("lang"), F.col("source")).alias("key"), "title",
        json_record(F.col("lang"), F.col("plans")).alias("content"),
    ))


def _markdown(t: Tables) -> DataFrame:
    """Documents as Markdown: every fourth line becomes a heading."""
    lines = F.transform(
        F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## "), x)).otherwise(x)
    )
    return t.documents.select("doc_id", "source", F.array_join(lines, "\n").alias("text"))


@plan("bigint doc_id section chars; string section_title", "J03",
      """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
      ), s AS (SELECT doc_id, i // 4 + 1 AS section, string_agg(line, chr(10) ORDER BY i) FILTER (i % 4 <> 0) AS body, min(line) FILTER (i % 4 = 0) AS head,
          count(*) AS n, (SELECT max(i) FROM l m WHERE m.doc_id = l.doc_id) AS last FROM l GROUP BY ALL)
      SELECT doc_id, section, coalesce(length(body), -1) + 1 + CASE WHEN last // 4 + 1 > section THEN 1 ELSE 0 END AS chars, trim(head) AS section_title FROM s
      UNION ALL SELECT doc_id, 0, 0, source FROM documents""")
def section_split(t: Tables) -> DataFrame:
    parts = search.sections(_markdown(t), "doc_id", "text", F.col("source"))
    return parts.select("doc_id", "section", F.length("body").alias("chars"), "section_title")


# A block longer than 500 characters step by step, then blocks and pieces packed one after the other.
_CHUNKS = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), s AS (SELECT doc_id, i // 4 + 1 AS section, string_agg(line, chr(10) ORDER BY i) FILTER (i % 4 <> 0) AS body, trim(min(line) FILTER (i % 4 = 0)) AS section_title FROM l GROUP BY ALL
), u AS (SELECT doc_id, section, string_split_regex(replace(body, chr(10) || '|', chr(10) || chr(10) || '|'), '\n\s*\n') AS parts FROM s WHERE body IS NOT NULL
), e AS (SELECT doc_id, section, generate_subscripts(parts, 1) AS b, regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g') AS block FROM u
), p AS (
  SELECT doc_id, section, b, block, 0 AS start, 0 AS k FROM e WHERE block <> ''
  UNION ALL
  SELECT doc_id, section, b, block, begun + length(substr(block, begun + 1)) - length(ltrim(substr(block, begun + 1), ' ' || chr(9) || chr(10) || chr(13))), k + 1 FROM (
    SELECT *, CASE WHEN again > 0 AND low + again - 1 > start THEN low + again - 1 ELSE cut END AS begun FROM (
      SELECT *, instr(substr(block, low + 1, cut - low), ' ') AS again FROM (
        SELECT *, greatest(cut - 80, start) AS low FROM (
          SELECT *, CASE WHEN space > 0 THEN start + 500 - space ELSE start + 500 END AS cut FROM (
            SELECT *, instr(reverse(substr(block, start + 251, 250)), ' ') AS space FROM p WHERE length(block) - start > 500)))))
), c AS (SELECT *, CASE WHEN length(block) - start > 500 THEN instr(reverse(substr(block, start + 251, 250)), ' ') END AS space FROM p
), items AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY b, k) AS i, length(block) > 500 AS alone,
    trim(CASE WHEN space IS NULL THEN substr(block, start + 1) WHEN space > 0 THEN substr(block, start + 1, 500 - space) ELSE substr(block, start + 1, 500) END,
      ' ' || chr(9) || chr(10) || chr(13)) AS piece FROM c
), g AS (
  SELECT doc_id, section, i, piece, length(piece) AS size, 0 AS chunk FROM items WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.section, n.i, n.piece, CASE WHEN NOT n.alone AND g.size + 1 + length(n.piece) <= 500 THEN g.size + 1 + length(n.piece) ELSE length(n.piece) END,
    g.chunk + CASE WHEN NOT n.alone AND g.size + 1 + length(n.piece) <= 500 THEN 0 ELSE 1 END
  FROM g JOIN items n ON n.doc_id = g.doc_id AND n.section = g.section AND n.i = g.i + 1
), t AS (SELECT doc_id, section, chunk, section_title || chr(10) || string_agg(piece, chr(10) ORDER BY i) AS content, section_title FROM g JOIN s USING (doc_id, section) GROUP BY doc_id, section, chunk, section_title)
SELECT doc_id, section, chunk, section_title, content FROM t WHERE length(regexp_replace(content, '[^\p{L}]', '', 'g')) / length(content) >= 0.4"""


@plan("bigint doc_id section chunk; string section_title content", "J03 J04 J05", _CHUNKS)
def chunk_documents(t: Tables) -> DataFrame:
    parts = search.sections(_markdown(t), "doc_id", "text", F.col("source"))
    rows = search.chunks(parts, "body")
    content = rows.withColumn("content", F.concat_ws("\n", "section_title", "chunk_text"))
    return search.wordy(content, "content")


@plan("string action; bigint documents", "J06",
      """WITH o AS (SELECT doc_id, CASE WHEN source = 'src3' THEN text || ' old' ELSE text END AS text FROM documents WHERE lang <> 'es'
      ), n AS (SELECT doc_id, text FROM documents WHERE lang <> 'de')
      SELECT CASE WHEN n.doc_id IS NULL THEN 'delete' WHEN o.doc_id IS NULL THEN 'add' WHEN o.text = n.text THEN 'keep' ELSE 'update' END AS action, count(*) AS documents
      FROM o FULL JOIN n USING (doc_id) GROUP BY 1""")
def incremental_index(t: Tables) -> DataFrame:
    old = t.documents.filter("lang <> 'es'").select(
        "doc_id", F.when(F.col("source") == "src3", F.concat("text", F.lit(" old"))).otherwise(F.col("text")).alias("text")
    )
    existing = old.select("doc_id", content_hash("m1", F.col("text")).alias("content_hash"))
    plan_ = search.index_plan(existing, t.documents.filter("lang <> 'de'"), "m1", ["doc_id"], "text")
    return plan_.groupBy("action").agg(F.count("*").alias("documents"))


@plan("bigint vec_id size; double first last norm", "J07",
      """SELECT vec_id, len(embedding) AS size, round_even(embedding[1]::DOUBLE / n * 1e8, 0) / 1e8 AS first, round_even(embedding[64]::DOUBLE / n * 1e8, 0) / 1e8 AS last, 1.0 AS norm
      FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)""")
def normalise_vectors(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", search.normalised(F.col("embedding"), 64).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select(
        "vec_id", F.size("v").alias("size"), half_even(F.col("v")[0], 8).alias("first"), half_even(F.col("v")[63], 8).alias("last"),
        half_even(norm, 8).alias("norm"),
    )


@plan("bigint query_id id position; double similarity", "J08", f"WITH {_CENTROIDS} SELECT query_id, id, position, similarity FROM vectors")
def vector_topk(t: Tables) -> DataFrame:
    return search.vector_candidates(t.embeddings, queries(t), "vec_id", "embedding")


@plan("bigint query_id id position; double similarity", "J08",
      f"""WITH {_CENTROIDS}, kinds AS (SELECT query_id, id, similarity FROM scored JOIN embeddings ON vec_id = id WHERE label % 3 = query_id % 3
      ) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS position FROM kinds QUALIFY position <= 30""")
def vector_index(t: Tables) -> DataFrame:
    """The search of `vector_topk` through blocks of neighbours, each query in one of three kinds of vectors."""
    kind = lambda c: (F.col(c) % 3).cast("string")
    blocks = search.vector_blocks(t.embeddings.withColumn("kind", kind("label")), "vec_id", "embedding", "kind", rows=64)
    return search.block_candidates(blocks, queries(t).withColumn("kind", kind("query_id")))


@plan("bigint query_id id covered hits position", "J09", f"WITH {_COVERAGE} SELECT query_id, id, covered, hits, position FROM texts")
def coverage_match(t: Tables) -> DataFrame:
    return search.coverage_candidates(t.documents, texts(t), "doc_id", F.col("text"), STOP)


@plan("bigint query_id id position; double similarity; boolean contains exact", "J10",
      f"WITH {_TITLES} SELECT query_id, id, position, round_even(similarity * 1e9, 0) / 1e9 AS similarity, contains, exact FROM titles")
def trigram_title(t: Tables) -> DataFrame:
    found = search.title_candidates(t.documents, texts(t), "doc_id", title())
    return found.withColumn("similarity", half_even(F.col("similarity"), 9))


def lists(t: Tables, asked: DataFrame) -> tuple[DataFrame, DataFrame, search.CoverageList, DataFrame]:
    """The vector list with its positions, title candidates without, the text list, and (id, file).

    Every third document has no file. Titles and files come from one written table, texts from the documents.
    """
    file = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    short = pinned(t.documents.select("doc_id", file.alias("file"), title().alias("title")))
    vectors = t.embeddings.join(short.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return (
        search.vector_candidates(vectors, asked, "vec_id", "embedding"),
        search.title_candidates(short, asked, "doc_id", F.col("title"), placed=False),
        search.CoverageList(t.documents, asked, "doc_id", F.col("text"), STOP),
        short.select(F.col("doc_id").alias("id"), "file"),
    )


def hits(t: Tables, asked: DataFrame) -> DataFrame:
    return search.top_fused(*lists(t, asked), 5)


@plan("bigint query_id id position; double relevance; string file", "J11 J12 J13 C10",
      f"WITH {_FUSED} SELECT query_id, id, position, relevance, file FROM hits")
def hybrid_rrf(t: Tables) -> DataFrame:
    return hits(t, queries(t)).select("query_id", "id", "position", "relevance", "file")


# Each document whose id is divisible by 50 is asked for by its second sentence, and by its vector with every fourth number left out.
_OWN = """SELECT doc_id AS query_id, sentence AS text FROM (
    SELECT doc_id, trim(regexp_replace(split_part(text, '.', 2), '\\s+', ' ', 'g')) AS sentence FROM documents WHERE doc_id % 50 = 0
  ) WHERE len(string_split(sentence, ' ')) >= 4"""
_OWN_VECTORS = f"""centroids AS (
  SELECT query_id, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i % 4 = 0 THEN 0 ELSE x END) AS c FROM embeddings JOIN ({_OWN}) ON vec_id = query_id
), scored AS (SELECT query_id, vec_id AS id, round_even(list_cosine_similarity(embedding::DOUBLE[], c) * 1e9, 0) / 1e9 AS similarity FROM embeddings CROSS JOIN centroids)"""


def own_queries(t: Tables) -> DataFrame:
    """Queries made from the documents themselves; each one's document is the one to be found."""
    sentence = F.btrim(F.regexp_replace(F.get(F.split("text", r"\."), F.lit(1)), r"\s+", " "))
    rows = t.documents.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), sentence.alias("text"))
    asked = rows.filter(F.size(F.split("text", " ")) >= 4)
    blurred = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i % 4 == 3, 0.0).otherwise(x))
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), blurred.alias("vector"))
    return pinned(asked.join(vectors, "query_id", "left"))


@plan("string list; bigint queries found; double recall mrr", "J14",
      f"""WITH {_fused(_OWN_VECTORS, _OWN)}, p AS (
        SELECT 'vector' AS list, query_id, position FROM held WHERE id = query_id UNION ALL SELECT 'title', query_id, position FROM titles WHERE id = query_id
        UNION ALL SELECT 'text', query_id, position FROM texts WHERE id = query_id UNION ALL SELECT 'fused', query_id, position FROM hits WHERE id = query_id
      ), a AS (SELECT unnest(['vector', 'title', 'text', 'fused']) AS list, query_id FROM texts_asked)
      SELECT list, count(*) AS queries, count(*) FILTER (position <= 5) AS found, round_even(count(*) FILTER (position <= 5) / count(*) * 1e6, 0) / 1e6 AS recall,
        round_even(avg(CASE WHEN position <= 5 THEN 1.0::DOUBLE / position ELSE 0 END) * 1e6, 0) / 1e6 AS mrr FROM a LEFT JOIN p USING (list, query_id) GROUP BY 1""")
def retrieval_quality(t: Tables) -> DataFrame:
    """How often each list and their fusion find the document that a query was made from."""
    asked = own_queries(t)
    vector, titles, texts_, files = lists(t, asked)
    vector, titles = pinned(vector), pinned(titles)
    fused = search.top_fused(vector, titles, texts_, files, 5)
    found = {"vector": vector, "title": search.in_order(titles, search.TITLE_ORDER, 5), "text": texts_.head(5), "fused": fused}
    expected = asked.select("query_id", F.col("query_id").alias("id"))
    result = None
    for name, hits_ in found.items():
        one = search.retrieval_quality(hits_, expected, 5).select(
            F.lit(name).alias("list"), "queries", "found", half_even(F.col("recall"), 6).alias("recall"), half_even(F.col("mrr"), 6).alias("mrr")
        )
        result = one if result is None else result.unionByName(one)
    return result
