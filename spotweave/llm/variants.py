"""Spelling variants by a relational trie frontier.

Words are nodes of a trie kept as a table of edges. States (word, rest, node, edits) walk it by joins, a level
at a time: a state without an edit stands on its word's own path; there it takes an edge that its word does not
take, which is the edit (another code point in place of the next one, or before it), and from then on the rest of the word must lie
along the edges. A state whose rest is used up where a word ends is a neighbour.

Two things keep the frontier small at every size. An edit lies in the second half of a word or in the second half of
the word read backwards, so states start in the second halves of paths through two tries, one of them of the words
backwards, and short prefixes that all words share are never joined. And chains of nodes without a branch are one edge with the
text of the chain, so there are as many levels as branches on a path, however long words are. A node is named by a 64-bit
hash of its prefix; two prefixes of one name can only add candidates, and every pair found is compared by its text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, blocks, forget, shared_dir, stored

#: Words have this many code points, and occurrences in all.
LEAST_CHARS, LEAST_COUNT = 7, 2
#: One occurrence in so many (by hash) loses a code point before it is counted; None leaves texts as they are.
MISSPELT = 31
#: A form occurs so many times as often as its variant.
RATIO = 10
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Code points of a batch of words that are hashed together.
_CELLS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, misspelt: int | None = MISSPELT) -> DataFrame:
    """(word, n) of all texts: runs of letters (ASCII and U+00C0 to U+00FF), A-Z lower-cased, of least_chars code points or more."""
    letters = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")  # a shorter run can't make a word
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(arrived):
        found: Counter = Counter()
        for batch in blocks(arrived, "text"):
            for i, raw in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if not raw:
                    continue
                start = crc32(b"" if i is None else str(i).encode())
                start = crc32(b":", start)
                for w, n in Counter(letters.findall(raw.lower().decode())).items():  # bytes lower-case A-Z alone
                    if misspelt:
                        h = crc32(w.encode(), start)
                        if not h % misspelt:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least_chars:
                                continue
                    found[w] += n
            if len(found) > HELD:
                yield batch_of(schema, list(found), list(found.values()))
                found.clear()
        if found:
            yield batch_of(schema, list(found), list(found.values()))

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_NODE = pa.schema([("no", pa.int64()), ("side", pa.int32()), ("depth", pa.int32()), ("node", pa.int64()), ("next", pa.int32())])


def _nodes(batches):
    """The nodes in the second half of each word's two paths, with the code point that follows (-1 at its end)."""
    for batch in batches:
        numbers, words = batch.column("no").to_numpy(), batch.column("word").to_pylist()
        size = np.fromiter(map(len, words), np.int64, len(words))
        order, start = np.argsort(size, kind="stable"), 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop + 1 - start) * size[order[stop]] <= _CELLS:
                stop += 1
            yield from _hashed(numbers[order[start:stop]], [words[k] for k in order[start:stop]], size[order[start:stop]])
            start = stop


def _hashed(numbers: np.ndarray, words: list[str], size: np.ndarray):
    wide = int(size.max(initial=0))
    letters = np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), wide)
    for side in (0, 1):
        first = (size - 1) // 2 if not side else size // 2
        h = np.full(len(words), side + 1, np.uint64)
        out: list[list] = []
        for depth in range(wide + 1):
            at = depth if not side else np.maximum(size - 1 - depth, 0)
            code = letters[np.arange(len(words)), np.minimum(at, wide - 1)]
            some = np.flatnonzero((first <= depth) & (depth <= size))
            if len(some):
                out.append([numbers[some], np.full(len(some), side), np.full(len(some), depth), _mixed(h[some]).view(np.int64), np.where(depth < size[some], code[some].astype(np.int64), -1)])
            h = h * _BASE + code.astype(np.uint64) + np.uint64(1)
        if out:
            yield batch_of(_NODE, *(pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), _NODE.types, strict=True)))


def _paths(words: DataFrame) -> DataFrame:
    """(word, n, side, text, path): the nodes of each word that have a branch or end a word, as (depth, node) in order; text is backwards on side 1."""
    nodes = words.select("no", "word").mapInArrow(_nodes, "no long, side int, depth int, node long, next int")
    kept = nodes.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b")).where("a = -1 or a <> b").select("node")
    kept = stored(kept, "branches")
    own = nodes.join(kept, "node", "left_semi").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("side", "depth", "node"))).alias("p"))  # at most two nodes a code point
    both = words.join(own, "no").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn("path", F.expr("filter(p, x -> x.side = side)")).withColumn("text", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))
    out = stored(both.select("word", "n", "side", "text", "path"), "paths")
    forget(kept)
    return out


def _edges(paths: DataFrame) -> DataFrame:
    """(node, head, label, child, heads, other, other_n): steps between nodes, with the code points that go on from the child, and the last edge of each word, with the word in place of a child.

    A step to a node where nothing goes on is left out: a state there has no way to use up its rest.
    """
    edge = """filter(transform(path, (x, i) -> if(i = 0, null, struct(path[i - 1].node as node,
        substring(text, path[i - 1].depth + 1, x.depth - path[i - 1].depth) as label, x.node as child, i = size(path) - 1 as last))), x -> x is not null)"""
    rows = paths.select("word", "n", F.explode(F.expr(edge)).alias("e")).select("word", "n", "e.*")
    on = paths.select("text", F.explode("path").alias("x")).where("x.depth < char_length(text)").select(F.col("x.node").alias("child"), F.expr("substring(text, x.depth + 1, 1)").alias("head"))
    heads = on.groupBy("child").agg(F.array_join(F.sort_array(F.collect_set("head")), "").alias("heads"))  # an alphabet at most
    steps = rows.where("not last").select("node", "label", "child").distinct().join(heads, "child")
    ends = rows.where("last").select("node", "label", F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = steps.unionByName(ends, allowMissingColumns=True)
    return both.select("node", F.substring("label", 1, 1).alias("head"), "label", "child", "heads", "other", "other_n")


#: What a step leaves of the rest: nothing at a word's end, elsewhere something that goes on from the node.
_GOES_ON = "if(child is null, rest = '', rest <> '' and contains(heads, substring(rest, 1, 1)))"


def _edited(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """First level: from its own path a word takes an edge that is not its own."""
    seeds = paths.select("word", "n", "side", "text", F.explode("path").alias("x"), F.char_length("word").alias("size"))
    half = F.floor(F.col("size") / 2)
    least = F.when(F.col("side") == 0, half).otherwise(F.col("size") - half)
    seeds = seeds.where(F.col("x.depth") >= least).select(
        "word", "n", F.col("x.node").alias("node"), F.expr("substring(text, x.depth + 1)").alias("own"), ((F.col("side") == 0) | (F.col("x.depth") > least)).alias("more")
    )
    # the edit replaces the next code point, or comes before it (the last of equal ones counts, so it differs from the next)
    replaced, added = "own <> '' and startswith(substring(own, 2), substring(label, 2))", "more and startswith(own, substring(label, 2))"
    met = seeds.join(edges, "node").where(f"head <> substring(own, 1, 1) and (({replaced}) or ({added}))")
    rests = f"array(if({replaced}, substring(own, char_length(label) + 1), null), if({added}, substring(own, char_length(label)), null))"
    return met.select("word", "n", "child", "heads", "other", "other_n", F.explode(F.expr(rests)).alias("rest")).where(f"rest is not null and {_GOES_ON}").drop("heads")


def _advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Next level: the rest of the word lies along an edge."""
    now = states.select("word", "n", F.col("child").alias("node"), F.col("rest").alias("own"), F.substring("rest", 1, 1).alias("head"))
    met = now.join(edges, ["node", "head"]).where("startswith(own, label)")
    return met.select("word", "n", "child", "heads", "other", "other_n", F.expr("substring(own, char_length(label) + 1)").alias("rest")).where(_GOES_ON).drop("heads")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words (columns no, word, n; distinct words) that are one inserted, deleted or replaced code point apart."""
    spark = words.sparkSession
    paths = _paths(words)
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"trie_edges_{uuid.uuid4().hex}"
    place = f"{shared_dir(spark)}/{name}"
    # bucketed: every level joins its states without shuffling the edges again
    _edges(paths).repartition(buckets, "node").write.format("parquet").option("path", place).bucketBy(buckets, "node").sortBy("node").saveAsTable(name)
    edges = spark.table(name)
    plain = spark.read.schema(edges.schema).parquet(place)  # for the widest level both sides are dealt anew, so that a node with very many words can be split
    levels = [stored(_edited(paths, plain), "states")]
    while True:
        states = levels[-1].where("child is not null")
        if states.isEmpty():
            break
        levels.append(stored(_advanced(states, edges), "states"))
    found = reduce(DataFrame.unionByName, [x.where("child is null").select("word", "n", "other", "other_n") for x in levels])
    found = found.where("levenshtein(word, other) = 1")
    # longer words are found from shorter ones; these pairs hold the other way too
    back = found.where("char_length(word) <> char_length(other)").select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    out = stored(found.unionByName(back).repartition("word").dropDuplicates(["word", "other"]), "near-words")
    spark.sql(f"DROP TABLE {name}")
    plain.stored_path = place
    for x in (*levels, paths, plain):
        forget(x)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word that links (word, form) lead to. Each round doubles the steps taken; links must not form a circle."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        after = stored(now.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "roots")
        forget(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_groups(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, misspelt: int | None = MISSPELT, ratio: int = RATIO) -> DataFrame:
    """One row per word of the texts with its commoner form: word, form, root, n, n_near, form_n.

    docs needs doc_id and text. A word's form is its near word (one code point inserted, deleted or replaced) with the largest
    n, of equal ones the smallest, if that is ratio times the word's own n at least, else null; root follows forms
    to the last. With `misspelt`, occurrences whose hash it divides lose a code point first, as if mistyped. A null or empty text
    has no words; a null doc_id is hashed as empty text; rows that repeat count again; other columns are ignored; an
    empty table gives an empty result. Texts and words of any length are taken whole.
    """
    counted = word_counts(docs, least_chars, misspelt).where(F.col("n") >= least_count)
    words = stored(counted.select(F.monotonically_increasing_id().alias("no"), "word", "n"), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b"))
    is_form = -F.col("b.m") >= ratio * F.col("n")
    out = words.select("word", "n").join(best, "word", "left")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("b.other")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n"))
    out = stored(out, "forms")
    for x in (words, near):
        forget(x)
    last = roots(out.where("form is not null").select("word", "form"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    """Forms and roots of all words of the documents."""
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = r"""
WITH tables AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run
  FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM found GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, tables
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT * FROM (
    SELECT x.word, y.word AS other, y.n AS other_n FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION ALL SELECT x.word, w.word, w.n FROM gaps x JOIN words w ON x.a || x.b = w.word
    UNION ALL SELECT w.word, x.word, x.n FROM gaps x JOIN words w ON x.a || x.b = w.word
  )
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, struct_pack(m := -other_n, o := encode(other))) AS other FROM near GROUP BY word
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN other END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)
), up AS (
  WITH RECURSIVE r AS (
    SELECT word, word AS root FROM forms UNION ALL SELECT r.word, f.form FROM r JOIN forms f ON f.word = r.root WHERE f.form IS NOT NULL
  ) SELECT word, root FROM r JOIN (SELECT word AS root, form FROM forms) USING (root) WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN up USING (word)
"""
