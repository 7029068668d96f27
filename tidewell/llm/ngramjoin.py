"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct 5-word shingles ("tokens", as 64-bit
hashes). Two documents link when their Jaccard similarity is at least 3/4; then
each misses at most a quarter of its own tokens. The join finds the components
of the link graph exactly:

1. ``set_stats``: per document its set size and the set's hash; equal sets
   become one node. ``frequent_cells``: tokens that more than ``RARE`` sets would
   index are marked *frequent* in a bit table of fixed size, counted over all
   documents. Marking moves a token behind the rare ones, which lets others into
   the prefixes, so the count is repeated for those. Which tokens are marked
   steers cost alone, as any fixed total order of tokens keeps the join exact;
   at a size where every cell is marked all sets index combinations.
2. ``signatures``: tokens are ordered rare first, then by hash. A node indexes
   single rare tokens. Where they don't suffice, the prefix is extended into the
   frequent tokens, which are dealt into small groups; only pairs of one group
   are indexed. The prefix ends when the singles plus, over all groups, (tokens
   taken - 1) exceed the misses that a partner may cause: whatever is missed,
   some single or some group with two tokens is left, and since the partner's
   prefix holds every token up to there, both index it. The number of groups
   goes by the power of two below the smaller set's size; a set also indexes
   under the next smaller power if a partner may be that small.
3. ``rare_pairs``: a signature of at most RARE nodes gives pairs, at most
   (RARE - 1) / 2 a row. Two filters that cannot lose a link go before the
   verification: by size, and by the number c of signatures that a pair shares.
   A prefix is built so that its tokens are need + (groups in it); of each group
   with s shared tokens s <= 1 + s (s - 1) / 2, so at most c + groups tokens are
   shared in the prefix that ends first, and c + n - need in all. A pair that
   shares a signature of more nodes, too, is compared in step 4.
4. ``hot_links``: signatures of more than RARE nodes come from near copies and
   shared passages, and the same nodes meet in many of them. All those
   signatures with the same first node (by hash) become one group, so a pair
   meets in few groups. No pair of a group is listed: its nodes are dealt into
   blocks, and from a block come only the links that join what it had apart.
   Two such deals contract what is linked; then the nodes of a group outside its
   largest component are compared with all nodes of it, again in blocks.

No text or set goes to the driver; the driver sees counts, and bit tables of
fixed size (8 MB).

Words: ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased. Fewer words
than five: the whole sequence is one shingle.

Defined cases: null, empty or blank text has the empty set and links with
nothing; a null id takes part and is never a component's id unless all its ids
are null; repeated rows are copies; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.textkit import SPACED, WordHasher, distinct, mix64, shingles, slices
from tidewell.llm.workdir import materialise

_LAST = (1 << 63) - 1
#: A token that more sets would index is frequent, and a signature that more have isn't listed in pairs.
RARE = 8
#: Bits of a table's number of cells; counts of the tokens that sets would index, at most.
CELL_BITS, ROUNDS = 26, 5
_RUN = 32768  # bits in one of Spark's bitmaps
#: Sets and tokens that a block has on either side, about; salts of a combination's rows.
BLOCK, BLOCK_TOKENS, SALTS = 512, 1 << 18, 16


def _sets(batch: pa.RecordBatch, hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, distinct tokens, their starts) of a batch's text column, in slices."""
    for a, b, buf, offsets in slices(batch.column("text")):
        hashes, _, _, first = hasher.words(buf, offsets)
        yield a, b, *distinct(*shingles(hashes, first))


def _node(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A set's hash, whatever its order: 0 for the empty set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(tokens ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)))
    return np.where(np.diff(at) > 0, mix64(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)), np.uint64(0)).view(np.int64)


def set_stats(docs: DataFrame) -> DataFrame:
    """Rows (id, n tokens, node), one per row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACED)
        for batch in batches:
            for a, b, tokens, at in _sets(batch, hasher):
                yield pa.record_batch({"id": batch.column("id").slice(a, b - a), "n": pa.array(np.diff(at).astype(np.int64)), "node": pa.array(_node(tokens, at))})

    return docs.mapInArrow(run, "id long, n long, node long")


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _marked(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which tokens lie in marked cells of a packed bit table."""
    cells = _cells(tokens)
    return (table[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)


def _prefix(at: np.ndarray, frequent: np.ndarray, ahead: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the single tokens that each set indexes (its first rare ones), and how many rare ones each has.

    ``ahead``: beyond them as many as the set has frequent tokens, up to twice the number, as the next are likely frequent, too.
    """
    rare = np.concatenate(([0], np.cumsum(~frequent)))
    own = np.diff(rare[at])
    need = np.diff(at) // 4 + 1
    if ahead:
        need = need + np.minimum(need, np.diff(at) - own)
    return ~frequent & (rare[:-1] - np.repeat(rare[at[:-1]], np.diff(at)) < np.repeat(need, np.diff(at))), own


def _pairs(tokens: np.ndarray, need: int, bracket: int) -> np.ndarray:
    """Signatures of pairs of frequent tokens (in hash order), until (tokens - groups) reaches ``need``."""
    groups = mix64(tokens ^ np.uint64(0x5BD1E995)) % np.uint64(max(1, (1 << bracket) // 2))
    _, first = np.unique(groups, return_index=True)
    again = np.ones(len(tokens), np.int64)
    again[first] = 0
    cut = int(np.searchsorted(np.cumsum(again), need)) + 1
    tokens, groups = tokens[:cut], groups[:cut]
    order = np.lexsort((tokens, groups))
    tokens, groups = tokens[order], groups[order]
    out, step = [], 1
    while step < len(tokens) and (same := groups[step:] == groups[:-step]).any():
        x, y = tokens[:-step][same], tokens[step:][same]
        out.append(mix64(x * np.uint64(3) + mix64(y + np.uint64(bracket))))
        step += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pair_signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of pairs of frequent tokens of a set whose rare ones don't suffice."""
    n, rare = len(tokens), int((~frequent).sum())
    brackets = {((3 * n + 3) // 4).bit_length() - 1, n.bit_length() - 1}
    return np.concatenate([_pairs(tokens[frequent], n // 4 + 1 - rare, b) for b in brackets])


def _fresh(nodes: np.ndarray, seen: set) -> np.ndarray:
    """Marks of the nodes that this task meets for the first time; never the empty set."""
    out = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes.tolist()):
        if node and node not in seen:
            seen.add(node)
            out[i] = True
    return out


def single_tokens(docs: DataFrame, table: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """Rows (sig) of the single tokens that sets may index; with ``before`` only those that they did not under that table."""
    sent = docs.sparkSession.sparkContext.broadcast((table, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, (new, old) = WordHasher(SPACED), set(), sent.value
        for batch in batches:
            for _, _, tokens, at in _sets(batch, hasher):
                take = _prefix(at, _marked(new, tokens), True)[0]
                if old is not None:
                    take &= ~_prefix(at, _marked(old, tokens), True)[0]
                take &= np.repeat(_fresh(_node(tokens, at), seen), np.diff(at))
                yield pa.record_batch({"sig": tokens[take].view(np.int64)})

    return docs.mapInArrow(run, "sig long")


def bit_table(keys: DataFrame, table: np.ndarray | None = None) -> np.ndarray | None:
    """Packed bit table with the cells (first bits) of 64-bit keys, and those of ``table``; None if there are no keys.

    The executors set the bits; what comes back has the table's size, whatever the number of keys.
    """
    cell = F.shiftrightunsigned(keys[0], 64 - CELL_BITS)
    runs = keys.select((cell / _RUN).cast("int").alias("run"), (cell % _RUN).alias("bit")).groupBy("run").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    if not runs:
        return None
    table = np.zeros(1 << CELL_BITS - 3, np.uint8) if table is None else table.copy()
    for r in runs:
        table[r.run * _RUN // 8 : (r.run + 1) * _RUN // 8] |= np.frombuffer(r.bits, np.uint8)
    return table


def frequent_cells(docs: DataFrame) -> np.ndarray:
    """Packed bit table of the cells of frequent tokens."""
    table, before = np.zeros(1 << CELL_BITS - 3, np.uint8), None
    for _ in range(ROUNDS):
        more = bit_table(single_tokens(docs, table, before).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > RARE).select("sig"), table)
        if more is None:
            break
        table, before = more, table
    return table


def signatures(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Rows (sig, node, n, salt): each set once a task, whatever its copies there. ``salt`` is 0 for single tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(SPACED), set()
        for batch in batches:
            for _, _, tokens, at in _sets(batch, hasher):
                nodes, sizes = _node(tokens, at), np.diff(at)
                fresh, often = _fresh(nodes, seen), _marked(sent.value, tokens)
                take, rare = _prefix(at, often)
                take &= np.repeat(fresh, sizes)
                wide = rare < sizes // 4 + 1
                sigs, owner = [tokens[take]], [np.repeat(np.arange(len(nodes)), sizes)[take]]
                for t in np.flatnonzero(fresh & wide).tolist():
                    sigs.append(pair_signatures(tokens[at[t] : at[t + 1]], often[at[t] : at[t + 1]]))
                    owner.append(np.full(len(sigs[-1]), t))
                rows = np.concatenate(owner)
                salt = np.where(np.arange(len(rows)) < len(sigs[0]), 0, 1 + (nodes[rows] & (SALTS - 1))).astype(np.int8)
                yield pa.record_batch({"sig": np.concatenate(sigs).view(np.int64), "node": nodes[rows], "n": sizes[rows].astype(np.int32), "salt": salt})

    return docs.mapInArrow(run, "sig long, node long, n int, salt byte")


def token_sets(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows (node, tokens, hot), one for each row (node, rep, hot) of ``owners``, from the row of ``docs`` (id, text) with id ``rep``.

    A bit table of the wanted rows, of fixed size, keeps most others in the scan; the join leaves out the rest.
    """
    # A node's bits are random, those of small ids are not; both are in the cell, so copies of a wanted text stay behind.
    table = bit_table(owners.select(F.col("node").bitwiseXOR(F.shiftleft("rep", 64 - CELL_BITS))))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACED)
        for batch in batches:
            ids = np.asarray(batch.column("rep"))
            for a, b, tokens, at in _sets(batch, hasher):
                node = _node(tokens, at)
                key = node.view(np.uint64) ^ (ids[a:b].astype(np.uint64) << np.uint64(64 - CELL_BITS))
                kept = _marked(sent.value, key) if sent.value is not None else np.zeros(b - a, bool)
                own = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.record_batch({"node": pa.array(node), "rep": pa.array(ids[a:b]), "tokens": own}).filter(pa.array(kept))

    found = docs.select(F.coalesce("id", F.lit(_LAST)).alias("rep"), "text").mapInArrow(run, "node long, rep long, tokens array<long>")
    return found.join(owners, ["node", "rep"]).groupBy("node", "rep").agg(F.first("tokens").alias("tokens"), F.first("hot").alias("hot")).drop("rep")


class _Forest(dict):
    """Union-find; the smallest of a tree is its root."""

    def find(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's edges (u, v) as stars around the smallest node of each tree."""
    up = _Forest()
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            up.join(u, v)
    pairs = [(x, r) for x in list(up) if (r := up.find(x)) != x]
    yield pa.record_batch({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the smallest node of its component, for every other node with an edge.

    Each task first contracts its own edges. Then large-star and small-star steps
    alternate until nothing changes; every step is an aggregate and an
    equi-join, each round is written to the shared folder.
    """
    e, last = materialise(edges.where("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "links"), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if mark == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e = materialise(small.distinct(), "links")


def _similar_size(a, b):
    return (F.least(a, b) * 4 >= F.greatest(a, b) * 3)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (u, v), those whose sets have 100 |u & v| >= 75 |u | v|."""
    x = sets.select(F.col("node").alias("u"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("v"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "u").join(y, "v").where(both * 100 >= (F.size("x") + F.size("y") - both) * 75).select("u", "v")


def rare_pairs(rows: DataFrame) -> DataFrame:
    """From the rows (sig, node, n) of signatures with few nodes: the pairs (u, v) that the filters leave."""
    a, b = (rows.select("sig", F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    outside = lambda s: F.col(f"n_{s}") - F.floor(F.col(f"n_{s}") / 4) - 1
    most = F.col("c") + F.greatest(outside("a"), outside("b"))
    return (
        a.join(b, "sig").where((F.col("node_a") < F.col("node_b")) & _similar_size("n_a", "n_b"))
        .groupBy(F.col("node_a").alias("u"), F.col("node_b").alias("v"), "n_a", "n_b").agg(F.count("*").alias("c"))
        .where(most * 7 >= (F.col("n_a") + F.col("n_b")) * 3).select("u", "v")
    )


def _block_links(group: pa.Table) -> pa.Table:
    """Links between the rows ``x`` and the rows ``y`` of a block: a spanning forest over its components so far.

    A row has (node, root, x, y, tokens); rows of one root are together already.
    """
    group = group.combine_chunks()
    nodes, roots, x, y = (np.asarray(group.column(c)) for c in ("node", "root", "x", "y"))
    lists = group.column("tokens").combine_chunks()
    flat, at = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    at = at - at[0]
    sizes, up, out = np.diff(at), _Forest(), []
    members = np.flatnonzero(y)
    owner = np.repeat(np.arange(len(members)), sizes[members])
    tokens = np.concatenate([flat[at[m] : at[m + 1]] for m in members] or [flat[:0]])
    order = np.argsort(tokens, kind="stable")
    tokens, owner, roots = tokens[order], owner[order], roots.tolist()
    for i in np.flatnonzero(x).tolist():
        own = flat[at[i] : at[i + 1]]
        lo, hi = np.searchsorted(tokens, own), np.searchsorted(tokens, own, "right")
        hits = np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if b > a] or [owner[:0]])
        shared = np.bincount(hits, minlength=len(members))
        for m in members[shared * 100 >= (sizes[members] + len(own) - shared) * 75].tolist():
            if up.join(roots[i], roots[m]):
                out.append((nodes[i], nodes[m]))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})


def _parts(sets: Column, tokens: Column) -> Column:
    """Blocks for so many sets with so many tokens."""
    return F.greatest(F.ceil(sets / BLOCK), F.ceil(tokens / BLOCK_TOKENS)).cast("int")


def hot_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within the groups ``rows`` (lead, node, n): a spanning forest of all there are."""
    links, roots = None, None
    deal = lambda count, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")

    def placed() -> DataFrame:
        """The groups that lie in several components so far, and the number of blocks of each."""
        own = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = own.groupBy("lead").agg(_parts(F.count("*"), F.sum("n")).alias("parts"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        # Written, so that a large group's rows needn't stay together for what comes next.
        return materialise(own.join(apart.select("lead", "parts"), "lead"), "groups-apart")

    def compared(blocks: DataFrame, keys: list[str]) -> DataFrame:
        return blocks.join(sets, "node").groupBy(*keys).applyInArrow(_block_links, "u long, v long")

    for turn in range(3):
        own = placed()
        if turn:  # a group of one block is done
            own = own.where("parts > 1")
            if own.isEmpty():
                break
        if turn < 2:
            blocks = own.select("lead", "node", "root", deal("parts", turn).alias("xb"), F.lit(True).alias("x"), F.lit(True).alias("y"))
            found = compared(blocks, ["lead", "xb"])
        else:
            largest = own.groupBy("lead", "root").agg(F.count("*").alias("k")).groupBy("lead").agg(F.max_by("root", F.struct("k", "root")).alias("most"))
            own = materialise(own.join(largest, "lead").withColumn("out", F.col("root") != F.col("most")), "groups-split")
            few = own.where("out").groupBy("lead").agg(_parts(F.count("*"), F.sum("n")).alias("x_parts"))
            own = own.join(few, "lead")
            every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
            x = own.where("out").select("lead", "node", "root", deal("x_parts", 2).alias("xb"), every("parts").alias("yb"), F.lit(True).alias("x"), F.lit(False).alias("y"))
            y = own.select("lead", "node", "root", deal("parts", 2).alias("yb"), every("x_parts").alias("xb"), F.lit(False).alias("x"), F.lit(True).alias("y"))
            found = compared(x.unionByName(y), ["lead", "xb", "yb"])
        found = materialise(found, "links-found")
        links = found if links is None else links.unionByName(found)
        if turn < 2:
            roots = components(links)
    return links


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id, n tokens, node, root).

    ``node`` is the hash of the row's set (equal for equal sets, 0 for the empty
    one), ``root`` one node of its component.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = materialise(set_stats(slim), "set-stats")

    # Combinations may have many nodes, so they are dealt by a salt, too, and stay; single tokens of one node go.
    near = Window.partitionBy("sig", "salt")
    rows = signatures(slim, frequent_cells(slim)).withColumn("lo", F.min("node").over(near)).withColumn("hi", F.max("node").over(near))
    rows = materialise(rows.where("lo < hi or salt > 0").select("sig", "node", "n").distinct(), "signatures")
    sizes = materialise(rows.groupBy("sig").agg(F.count("*").alias("g")).where("g > 1"), "signature-sizes")
    pairs = materialise(rare_pairs(rows.join(sizes.where(F.col("g") <= RARE).select("sig"), "sig")), "pairs")
    hot = materialise(rows.join(sizes.where(F.col("g") > RARE).select("sig"), "sig"), "signatures-hot")
    leads = hot.groupBy("sig").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("lead"))).alias("first")).select("sig", "first.lead")
    hot = materialise(hot.join(leads, "sig").select("lead", "node", "n").distinct(), "groups")

    ends = [pairs.select(F.col(c).alias("node"), F.lit(False).alias("hot")) for c in "uv"]
    wanted = hot.select("node", F.lit(True).alias("hot")).unionByName(ends[0]).unionByName(ends[1]).groupBy("node").agg(F.max("hot").alias("hot"))
    owners = own.where("node <> 0").groupBy("node").agg(F.min(F.coalesce("id", F.lit(_LAST))).alias("rep")).join(wanted, "node")
    sets = materialise(token_sets(slim, materialise(owners, "set-owners")), "token-sets")
    roots = components(materialise(verify(pairs, sets), "links-found").unionByName(hot_links(hot, sets.where("hot").drop("hot"))))
    return own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("id", "n", "node", "root")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id, n_shingles, component_id, node).

    ``component_id`` is the smallest id reachable by links, ``node`` the hash of
    the row's set (equal for equal sets, 0 for the empty one).
    """
    placed = linked(docs, id_col, text_col)
    first = placed.where("node <> 0").groupBy("root").agg(F.min("id").alias("component"))
    return placed.join(first, "root", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("node") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"), "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, one with a null id if all are null.

    Documents with the empty set all stay. Of rows that repeat an id and its text
    one stays, also where the id is null. Rows with a null id join by the hash of
    their text.
    """
    mark, docs_columns = f"nj_{uuid.uuid4().hex[:8]}", docs.columns
    key, row, one, again = (f"{mark}_{c}" for c in ("key", "row", "one", "again"))
    lost, worded = F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^ \t-\r]")
    known = docs.where(~lost)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    nulls = docs.where(lost & worded).groupBy(F.xxhash64(text_col).alias(key)).agg(F.min_by(F.struct(*docs_columns), F.xxhash64(*plain)).alias(row))
    nulls = materialise(nulls, "null-ids")
    found = linked(
        known.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .unionByName(nulls.select(F.col(key).alias("id"), F.col(row)[text_col].alias("text"))), "id", "text")
    found = found.join(nulls.select(F.col(key).alias("id"), F.lit(True).alias("lost")), "id", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    best = found.where("node <> 0").groupBy("root").agg(F.min(F.struct("lost", "id")).alias("best"))
    keep = (
        found.join(best, "root", "left").where((F.struct("lost", "id") == F.col("best")) | (F.col("n") == 0))
        .groupBy("lost", F.col("id").alias(key)).agg(F.max(F.col("n") > 0).alias(one))
    )
    # The window reuses the join's partitioning.
    order = Window.partitionBy(key).orderBy(F.xxhash64(text_col))
    repeat = F.lag(F.xxhash64(text_col)).over(order).eqNullSafe(F.xxhash64(text_col)) & (F.row_number().over(order) > 1)
    kept = (
        known.withColumn(key, F.col(id_col).cast("long")).join(keep.where("not lost").drop("lost"), key)
        .withColumn(again, F.col(one) & repeat).where(~F.col(again)).select(*docs_columns)
    )
    chosen = nulls.join(keep.where("lost").select(key), key, "left_semi").select(F.col(f"{row}.*"))
    return kept.unionByName(chosen).unionByName(docs.where(lost & ~worded))
