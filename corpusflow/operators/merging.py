"""Merges of notes: who becomes whom as connected components, and headers, sections and links that follow.

Pairs that are to be merged are contracted: every label takes the least label beside it, chains of such steps are shortened by jumping, and the
pairs are written again over the new labels until none joins two of them, so a chain of any length takes a few rounds. The merged
note unites the headers of its parts, joins their sections of one title and keeps their ids as aliases; links of
all notes go through the component map; anti-joins state what would have been lost.

A null id is no note; a pair with itself, repeated pairs and pairs of unknown notes change nothing; without pairs every note stays what it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import program, table
from corpusflow.plans.durable import empty, written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and label, the least node that edges(a, b) connect it with."""
    label = written(nodes.where("node IS NOT NULL").select("node", F.col("node").alias("label")).distinct(), "labels")
    rest = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    rest = rest.join(label.select(F.col("node").alias("a")), "a", "left_semi").join(label.select(F.col("node").alias("b")), "b", "left_semi")
    rest = written(rest.where("a <> b").distinct(), "pairs")
    while not empty(rest):
        both = rest.union(rest.select("b", "a"))
        # each label points to the least beside it, if that is less; least labels point nowhere, so there are no rings
        up = written(both.groupBy("a").agg(F.min("b").alias("up")).where("up < a").select(F.col("a").alias("x"), "up"), "up")
        while True:
            far = up.alias("p").join(up.alias("q"), F.col("p.up") == F.col("q.x"), "left").select("p.x", F.coalesce("q.up", "p.up").alias("up"), F.col("q.up").isNotNull().alias("moved"))
            far = written(far, "up")
            up = far.select("x", "up")
            if empty(far.where("moved")):
                break
        label = written(label.join(up, F.col("label") == F.col("x"), "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        to = lambda c: F.coalesce(F.col(f"{c}.up"), F.col(f"e.{c}"))
        rest = rest.alias("e").join(up.alias("a"), F.col("e.a") == F.col("a.x"), "left").join(up.alias("b"), F.col("e.b") == F.col("b.x"), "left").select(to("a").alias("a"), to("b").alias("b"))
        rest = written(rest.where("a <> b").distinct(), "pairs")
    return label


@dataclass
class Merge:
    #: note_id -> merged, for every note.
    names: DataFrame
    #: merged, title, aliases, tags, related, n_parts.
    notes: DataFrame
    #: merged, section, title, ord, note_id, block_ref, text: sections of one title stand where the first of them stood.
    blocks: DataFrame
    #: merged, section, note_id, ord, text and what they stand by in the merged note: _first, place, note_id, ord.
    placed: DataFrame
    #: src, dst, kind, rewritten: each link once.
    links: DataFrame
    #: from_note, target: redirected ids.
    debt: DataFrame
    #: what and key: references and links that the merge would lose; empty if it is sound.
    lost: DataFrame


#: Of the blocks in a merged note.
_ORDER = ("_first", "place", "note_id", "ord")


def merge(notes: DataFrame, blocks: DataFrame, links: DataFrame, pairs: DataFrame) -> Merge:
    """notes(note_id, place, title, aliases, tags, related), blocks(note_id, ord, section, text, block_ref), links(src, dst, kind), pairs(a, b)."""
    names = components(notes.select(F.col("note_id").alias("node")), pairs).select(F.col("node").alias("note_id"), F.col("label").alias("merged"))
    names = names.withColumn("n_parts", F.count("*").over(Window.partitionBy("merged")))
    own = notes.join(names, "note_id")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    old = F.collect_set(F.when(F.col("n_parts") > 1, F.col("note_id")))
    header = own.groupBy("merged").agg(
        F.max_by(F.when(F.col("title") != "", F.col("title")), F.when(F.col("title") != "", F.struct("place", "note_id"))).alias("title"),
        F.array_sort(F.array_union(union("aliases"), old)).alias("aliases"),
        union("tags").alias("tags"),
        union("related").alias("related"),
        F.first("n_parts").alias("n_parts"),
    )
    placed = blocks.join(own.select("note_id", "merged", "place"), "note_id")
    first = placed.where("section IS NOT NULL").groupBy("merged", "section").agg(F.min(F.struct("place", "note_id", "ord")).alias("_first"))
    placed = placed.join(first, ["merged", "section"], "left").withColumn("_first", F.coalesce("_first", F.struct("place", "note_id", "ord")))
    order = Window.partitionBy("merged").orderBy(*_ORDER)
    body = placed.select("merged", "section", (F.row_number().over(order) - 1).cast("long").alias("ord"), "note_id", F.col("ord").alias("was"), "block_ref", "text")
    to = lambda c: F.coalesce(F.col(f"{c}.merged"), F.col(f"l.{c}"))
    sent = links.alias("l").join(names.alias("src"), F.col("l.src") == F.col("src.note_id"), "left").join(names.alias("dst"), F.col("l.dst") == F.col("dst.note_id"), "left")
    sent = sent.select(to("src").alias("src"), to("dst").alias("dst"), "kind", ((to("src") != F.col("l.src")) | (to("dst") != F.col("l.dst"))).alias("rewritten"))
    # a link between parts of one note is none
    sent = sent.where("NOT (rewritten AND src = dst)").groupBy("src", "dst", "kind").agg(F.max("rewritten").alias("rewritten"))
    debt = names.where("n_parts > 1").select(F.col("note_id").alias("from_note"), F.col("merged").alias("target"))
    refs = blocks.where("block_ref IS NOT NULL").select("block_ref").distinct().join(body.select("block_ref"), "block_ref", "left_anti")
    gone = names.where("note_id <> merged").select(F.col("note_id").alias("dst"))
    lost = refs.select(F.lit("reference").alias("what"), F.col("block_ref").alias("key")).union(sent.join(gone, "dst", "left_semi").select(F.lit("link"), F.col("dst")))
    return Merge(names.select("note_id", "merged"), header, body, placed, sent, debt, lost)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """merged, n_blocks and body, the digest of its texts between bars, of rows (merged, text) that come in order; one digest is held, and no text."""

    def row():
        return pa.RecordBatch.from_pylist([{"merged": now, "n_blocks": n, "body": digest and digest.hexdigest()}], _DIGESTED)

    now, n, digest = None, 0, None
    for batch in batches:
        for merged, text in zip(*(batch.column(c).to_pylist() for c in ("merged", "text"))):
            if merged != now:
                if n:
                    yield row()
                now, n, digest = merged, 0, None
            n += 1
            if text is not None:
                if digest is None:
                    digest = hashlib.sha256()
                else:
                    digest.update(b"|")
                digest.update(text.encode())
    if n:
        yield row()


_DIGESTED = pa.schema([("merged", pa.string()), ("n_blocks", pa.int64()), ("body", pa.string())])


table(
    "merge_notes",
    "SELECT note_id, doc_id AS place, title, CASE WHEN doc_id % 3 = 0 THEN $array('alias-' || $text(doc_id % 20)) ELSE $array(title) END AS aliases, $array(domain) AS tags, $array('note-' || $text(doc_id + 1)) AS related, note_type FROM {notes}",
)
table("merge_blocks", "SELECT note_id, ord, CASE WHEN node = 'heading' THEN lower(text) WHEN node = 'callout' THEN 'notes' END AS section, text, block_ref FROM {nodes}")
# Notes of one type and title, each with the one before it: chains.
table("merge_pairs", "SELECT a, b FROM (SELECT lag(note_id) OVER (PARTITION BY note_type, lower(title) ORDER BY place) AS a, note_id AS b FROM {merge_notes}) WHERE a IS NOT NULL UNION ALL SELECT 'note-' || $text(place), 'note-' || $text(place + 1) FROM {merge_notes} WHERE place % 10 IN (3, 4, 5)")
_COMPONENTS = """
WITH RECURSIVE ids AS (SELECT note_id, place FROM {notes}), e AS (SELECT p.a, p.b FROM {pairs} p SEMI JOIN ids x ON x.note_id = p.a SEMI JOIN ids y ON y.note_id = p.b),
sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, other) AS (SELECT note_id, note_id FROM ids UNION SELECT r.node, b.b FROM reach r JOIN sides b ON b.a = r.other),
names AS (SELECT node AS note_id, min(other) AS merged, count(*) AS n_parts FROM reach GROUP BY node)"""


@program(
    "dup_merge",
    _COMPONENTS
    + """,
h AS (SELECT merged, max(n_parts)::BIGINT AS n_parts, arg_max(title, place) AS title, list_sort(list_distinct(flatten(list(aliases)) || coalesce(list(note_id) FILTER (WHERE n_parts > 1), []))) AS aliases, list_sort(list_distinct(flatten(list(tags)))) AS tags FROM {notes} n JOIN names USING (note_id) GROUP BY merged),
b AS (SELECT merged, coalesce(section, note_id || ' ' || ord::VARCHAR) AS section, place, ord, text FROM {blocks} x JOIN names USING (note_id) JOIN ids USING (note_id)),
o AS (SELECT *, min(place * 1000000 + ord) OVER (PARTITION BY merged, section) AS f FROM b),
t AS (SELECT merged, count(*)::BIGINT AS n_blocks, count(DISTINCT section)::BIGINT AS n_sections, sha256(string_agg(text, '|' ORDER BY f, place, ord)) AS body FROM o GROUP BY merged)
SELECT h.merged, h.n_parts, h.title, array_to_string(aliases, ',') AS aliases, array_to_string(tags, ',') AS tags, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_sections, 0) AS n_sections, body, 0::BIGINT AS lost FROM h LEFT JOIN t ON t.merged = h.merged
""",
    first={"blocks": "dealt_blocks", "notes": "notes"},
    notes="merge_notes",
    blocks="merge_blocks",
    links="note_links",
    pairs="merge_pairs",
)
def dup_merge(notes, blocks, links, pairs):
    """Merged notes with united headers and sections, and how many references or links the merges lost."""
    done = merge(notes, blocks, links, pairs)
    sections = F.countDistinct(F.coalesce("section", F.concat("note_id", F.lit(" "), F.col("ord").cast("string"))))
    sections = done.placed.groupBy("merged").agg(sections.alias("n_sections"))
    # a merged note may hold a share of all texts, so they stream in order into its digest
    body = done.placed.repartition("merged").sortWithinPartitions("merged", *_ORDER).select("merged", "text").mapInArrow(_digested, "merged string, n_blocks long, body string")
    lost = done.lost.agg(F.count("*").alias("lost"))
    out = done.notes.join(body, "merged", "left").join(sections, "merged", "left").crossJoin(F.broadcast(lost))
    return out.select("merged", "n_parts", "title", F.array_join("aliases", ",").alias("aliases"), F.array_join("tags", ",").alias("tags"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), F.coalesce("n_sections", F.lit(0)).cast("long").alias("n_sections"), "body", "lost")


@program(
    "dup_merge_links",
    _COMPONENTS
    + """,
m AS (SELECT coalesce(s.merged, l.src) AS src, coalesce(d.merged, l.dst) AS dst, kind, coalesce(s.merged, l.src) <> l.src OR coalesce(d.merged, l.dst) <> l.dst AS rewritten FROM {links} l LEFT JOIN names s ON s.note_id = l.src LEFT JOIN names d ON d.note_id = l.dst)
SELECT src, dst, kind, bool_or(rewritten) AS rewritten FROM m WHERE NOT (rewritten AND src = dst) GROUP BY src, dst, kind
""",
    notes="merge_notes",
    blocks="merge_blocks",
    links="note_links",
    pairs="merge_pairs",
)
def dup_merge_links(notes, blocks, links, pairs):
    """Links of all notes after the merges, through the map of merged ids."""
    return merge(notes, blocks, links, pairs).links


def within(names: DataFrame, known: DataFrame, limit: int = 2) -> DataFrame:
    """name, other and distance of names(name) and known(other) at most limit edits apart, by joining what both become when up to limit characters are left out.

    Two texts that near share such a remainder, so none is lost; each pair that shares one is checked. The remainders grow with length to the power of limit:
    this is for names, not for texts."""

    def remainders(df: DataFrame, column: str) -> DataFrame:
        df = df.where(f"{column} IS NOT NULL").select(column).distinct().withColumn("key", F.col(column))
        for _ in range(limit):
            shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1))), lambda i: F.concat(F.substring("key", F.lit(1), i - 1), F.substring("key", i + 1, F.length("key"))))
            df = df.select(column, F.explode(F.array_distinct(F.concat(F.array("key"), shorter))).alias("key")).distinct()
        return df

    pairs = remainders(names, "name").join(remainders(known, "other"), "key").select("name", "other").distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "other", limit).cast("long")).where("distance >= 0")


table("mistyped", "SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 2) || substr(p_name, 4) WHEN 2 THEN substr(p_name, 1, 3) || 'x' || substr(p_name, 4) WHEN 3 THEN 'q' || substr(p_name, 2) || 'z' ELSE p_name || ' or' END AS name FROM {part}")
table("known_names", "SELECT DISTINCT p_name AS other FROM {part}")


@program(
    "sim_levenshtein_limit",
    "SELECT name AS unknown, arg_min(other, (d, other)) AS suggestion, min(d)::BIGINT AS distance, count(*)::BIGINT AS n_near FROM (SELECT name, other, levenshtein(name, other) AS d FROM {names} CROSS JOIN {known}) WHERE d <= 2 GROUP BY name",
    names="mistyped",
    known="known_names",
)
def sim_levenshtein_limit(names, known):
    """Did you mean: the nearest known name at most two edits away, the first in order where several are as near, and how many there are."""
    near = within(names, known)
    return near.groupBy(F.col("name").alias("unknown")).agg(F.min_by("other", F.struct("distance", "other")).alias("suggestion"), F.min("distance").alias("distance"), F.count("*").alias("n_near"))
