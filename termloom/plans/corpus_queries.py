"""Queries over the corpus as a whole: a lexicon and segmentation of text without spaces, parts of the whole vocabulary,
an index of vectors, PageRank up to its stopping rule, and the dictionary's log of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, dictionary_index, dictionary_log, graph, parts, segment, vector_index, vectors
from ..sources.shared import cut, shared_dir
from .oracle import CNT, ORACLE
from .queries import _dictionary, _half, _headwords, _nodes
from .registry import query, twin

#: Runs of lower-case letters, without the spaces between words; digits stand as they are.
RUN, WHOLE = "[a-zà-ÿ]+", "[0-9]+"


def unspaced(documents: DataFrame) -> DataFrame:
    """Texts in lower case without their blanks: what a lexicon has to find the words of."""
    return documents.select("doc_id", F.regexp_replace(F.lower("text"), r"[ \t]+", "").alias("text"))


def _texts(documents: DataFrame) -> DataFrame:
    return unspaced(segment.dealt(documents))


def _lexicon(texts: DataFrame) -> DataFrame:
    return segment.learn(texts, run=RUN, whole=WHOLE, most=1 << 14)


def _found(documents: DataFrame, made) -> DataFrame:
    """What ``made`` finds in unspaced texts by the lexicon that is learnt from them."""
    texts = _texts(documents)
    return made(texts, segment.lexicon(_lexicon(texts)), run=RUN, whole=WHOLE)


@query
def learnt_lexicon(documents):
    """The words of a lexicon learnt from unspaced text, with their costs; tested against plain Python."""
    return _lexicon(_texts(documents))


@query
def segmented_tokens(documents):
    """How often each mode's segmentation of unspaced text has each word; tested against all paths of a lattice."""
    return _found(documents, segment.token_counts)


@query
def segmented_nouns(documents):
    """C4: single nouns of segmented text."""
    return _found(documents, segment.document_nouns)


@query
def segmented_compounds(documents):
    """N-grams of the noun runs of segmented text, none across a blank or a mark."""
    return _found(documents, segment.document_compounds)


@query
def segmented_subtypes(documents):
    """Nouns of all modes whose subtype makes a term, and technical terms."""
    return _found(documents, segment.document_subtypes)


_VOCABULARY = f"{CNT}, vo AS (SELECT term, CAST(sum(frequency) AS BIGINT) AS frequency FROM cnt GROUP BY term)"
_LENGTHS = "SELECT DISTINCT length(term) AS k FROM vo WHERE length(term) >= 2"
_PARTS = f"""pa AS (SELECT DISTINCT p.term, p.container, p.frequency FROM (SELECT c.term AS container, c.frequency, substr(c.term, i, k) AS term
  FROM (SELECT v.*, k, unnest(range(1, length(v.term) - k + 2)) AS i FROM vo v JOIN ({_LENGTHS}) l ON l.k < length(v.term)) c) p SEMI JOIN vo ON p.term = vo.term)"""


def _vocabulary(documents: DataFrame) -> DataFrame:
    return candidates.term_counts(documents).groupBy("term").agg(F.sum("frequency").alias("frequency"))


@twin(f"WITH {_VOCABULARY}, {_PARTS} SELECT term, container, frequency AS container_frequency FROM pa")
@query
def corpus_containment(documents):
    """The terms of the whole corpus that are parts of others."""
    return parts.containment(_vocabulary(documents))


def _corpus_cvalue(variant: int, weight: str) -> None:
    def run(documents):
        return parts.c_value(_vocabulary(documents), variant).select("term", "frequency", "containers", F.round("c_value", 6).alias("c_value"))

    run.__name__ = f"corpus_cvalue_v{variant}"
    run.__doc__ = f"A{variant + 2} over the whole corpus."
    twin(f"WITH {_VOCABULARY}, {_PARTS}, me AS (SELECT term, avg(frequency) AS m, count(*) AS n FROM pa GROUP BY term) SELECT vo.term, vo.frequency, coalesce(n, 0) AS containers, round(greatest(0.0, {weight} * (vo.frequency - coalesce(m, 0.0))), 6) AS c_value FROM vo LEFT JOIN me USING (term)")(query(run))


for _v, _w in ((1, "log2(length(vo.term) + 1)"), (2, "log2(length(vo.term))"), (3, "log2(greatest(2, length(vo.term)))")):
    _corpus_cvalue(_v, _w)


def _place(table: DataFrame, name: str) -> str:
    return f"{shared_dir(table.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query
def indexed_neighbours(embeddings):
    """The twelve nearest rows of every row by an index in lists; recall is measured in the tests."""
    path = _place(embeddings, "index")
    vector_index.build(embeddings, path)
    return vector_index.search(path, embeddings, 12, 0.30).select("src", "dst", F.round("weight", 6).alias("weight"))


@twin("""WITH u AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id % 10 <> 3), n AS (SELECT vec_id + CASE WHEN vec_id % 7 = 0 THEN 1000000 ELSE 0 END AS id, list_transform(embedding, lambda x: -x) AS embedding FROM embeddings WHERE vec_id % 5 = 0),
s AS (SELECT * FROM n UNION ALL SELECT * FROM u ANTI JOIN n USING (id))
SELECT id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, len(embedding) AS dim FROM s""")
@query
def vector_store_upsert(embeddings):
    """V5: an index that rows are put into, some in the place of others: what it holds then. Nine rows of ten are there at
    first, and a fifth of all comes turned about, partly with new ids."""
    path = _place(embeddings, "index")
    vector_index.build(embeddings.where("vec_id % 10 <> 3"), path)
    turned = embeddings.where("vec_id % 5 = 0").select(F.expr("vec_id + if(vec_id % 7 = 0, 1000000, 0)").alias("vec_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    vector_index.upsert(path, turned)
    return vector_index._stored(embeddings.sparkSession, path).select("id", F.round(F.col("v")[0], 6).alias("first"), F.size("v").cast("long").alias("dim"))


@query
def pagerank_converged(embeddings):
    """PageRank of the corpus-wide graph up to its stopping rule; tested against plain Python."""
    edges = cut(graph.undirected(vectors.knn(embeddings)))
    return graph.pagerank_large(_nodes(embeddings).select("id", "p"), edges).select("id", F.round("pagerank", 8).alias("pagerank"))


@twin(ORACLE["dictionary_upsert"])
@query
def dictionary_from_log(documents):
    """K3: the documents' second half of headwords as a batch of changes upon the first, merged when they are read."""
    store = _place(documents, "dictionary")
    dictionary_log.start(store, _half(documents, 0))
    dictionary_log.append(store, 0, _half(documents, 1), F.lit("2024-01-01").cast("timestamp"))
    out = dictionary_log.read(documents.sparkSession, store)
    return out.select("headword", F.array_join("synonyms", ",").alias("synonyms"), "definition", "category", F.round("confidence", 6).alias("confidence"), F.array_join("source_docs", ",").alias("source_docs"), F.col("updated_at").isNotNull().alias("touched"))


@twin(ORACLE["dictionary_search"])
@query
def dictionary_indexed_search(documents):
    """K5: the same search by posting lists of the headwords' grams."""
    path = _place(documents, "search")
    dictionary_index.build(_dictionary(_headwords(documents)), path)
    out = dictionary_index.search(documents.sparkSession, path, "TION", 10)
    return out.select("headword", F.round("confidence", 6).alias("confidence"))
