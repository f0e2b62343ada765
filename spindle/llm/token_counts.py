"""Edit-aware token counts over pre-token segment trees (operator 3).

A text is cut into segments of at least ``SEGMENT`` code points, each a run of whole pre-tokens. They
are the leaves of a document's tree; an inner node has up to ``FAN`` children and the sums of their
code points and tokens, so the root holds the document's counts. All levels are kept as a table.

An edit is found by descent from the root. Only the segments that it touches are encoded anew, with
the one before as boundary context and then on until a pre-token begins where an old segment did: from
there on the text is cut as before. The new leaves take the old ones' place, nodes on the path split
or merge, and their sums are made again; all else stays as it was read, unopened.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread, stage, text_of
from .encoding import encoder

SEGMENT, FAN = 256, 16
#: By level from the leaves: the children of each node (none of a leaf), its code points, its tokens.
LEVELS_SCHEMA = "array<struct<kids:array<int>,lengths:array<int>,tokens:array<int>>>"
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(slots=True)
class Node:
    height: int
    length: int
    tokens: int
    kids: list[Node] | None = None  # None: not opened, or a leaf
    at: int = -1  # place in the stored level


def _cuts(n: int) -> list[tuple[int, int]]:
    """How n children are dealt to nodes: FAN at most, about equally many each."""
    nodes = -(-n // FAN)
    cuts = [n * i // nodes for i in range(nodes + 1)] if nodes else []
    return list(zip(cuts, cuts[1:]))


def stacked(leaves: list[tuple[int, int]]) -> list[Level]:
    """The levels over new leaves, without nodes in between."""
    if not leaves:
        return []
    lengths, tokens = map(list, zip(*leaves))
    out = [([], lengths, tokens)]
    while len(lengths) > 1:
        cuts = _cuts(len(lengths))
        lengths, tokens = [sum(lengths[a:b]) for a, b in cuts], [sum(tokens[a:b]) for a, b in cuts]
        out.append(([b - a for a, b in cuts], lengths, tokens))
    return out


def _above(kids: list[Node]) -> list[Node]:
    parts = [kids[a:b] for a, b in _cuts(len(kids))]
    return [Node(p[0].height + 1, sum(k.length for k in p), sum(k.tokens for k in p), p) for p in parts]


def _rooted(nodes: list[Node]) -> Node | None:
    while len(nodes) > 1:
        nodes = _above(nodes)
    root = nodes[0] if nodes else None
    while root and root.kids and len(root.kids) == 1:
        root = root.kids[0]
    return root


class Tree:
    def __init__(self, root: Node | None, stored: list[Level] | None = None) -> None:
        self.root, self.stored = root, stored or []
        self.first = [np.concatenate(([0], np.cumsum(kids))) if h else None for h, (kids, *_) in enumerate(self.stored)]
        self.opened = 0  # nodes read or made since

    @classmethod
    def of_leaves(cls, leaves: list[tuple[int, int]]) -> Tree:
        return cls(_rooted([Node(0, n, t) for n, t in leaves]))

    @classmethod
    def of_levels(cls, stored: list[Level]) -> Tree:
        if not stored:
            return cls(None)
        _, lengths, tokens = stored[-1]
        return cls(Node(len(stored) - 1, int(lengths[0]), int(tokens[0]), None, 0), stored)

    @property
    def total(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def length(self) -> int:
        return self.root.length if self.root else 0

    def _kids(self, node: Node) -> list[Node]:
        if node.kids is None:
            a, b = self.first[node.height][node.at : node.at + 2].tolist()
            _, lengths, tokens = self.stored[node.height - 1]
            node.kids = [Node(node.height - 1, n, t, None, a + i) for i, (n, t) in enumerate(zip(lengths[a:b].tolist(), tokens[a:b].tolist()))]
            self.opened += b - a
        return node.kids

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Where the leaf that holds the code point at ``place`` starts and stops."""
        node, start = self.root, 0
        while node.height:
            for kid in self._kids(node):
                if place < start + kid.length:
                    break
                start += kid.length
            else:  # at the end of the text
                start -= kid.length
            node = kid
        return start, start + node.length

    def splice(self, start: int, stop: int, leaves: list[tuple[int, int]]) -> None:
        """Put new leaves in the place of those from start to stop (where leaves begin or end)."""
        fresh = [Node(0, n, t) for n, t in leaves]
        self.opened += len(fresh)
        if self.root is None or self.root.height == 0:
            old = [self.root] if self.root and start == stop else []
            self.root = _rooted(fresh + old if start == 0 else old + fresh)
        else:
            self.root = _rooted(self._spliced(self.root, start, stop, fresh))

    def _spliced(self, node: Node, start: int, stop: int, fresh: list[Node]) -> list[Node]:
        """What takes the node's place, of its height."""
        kids, ends, at = self._kids(node), [], 0
        for kid in kids:
            at += kid.length
            ends.append(at)
        begins = [0, *ends[:-1]]
        if node.height == 1:
            i = sum(e <= start for e in ends)
            j = max(i, sum(b < stop for b in begins))
            return _above(kids[:i] + fresh + kids[j:])
        i = min(sum(e <= start for e in ends), len(kids) - 1)
        j = max(i, sum(b < stop for b in begins) - 1)
        if i == j:
            middle = self._spliced(kids[i], start - begins[i], stop - begins[i], fresh)
        else:
            middle = self._spliced(kids[i], start - begins[i], kids[i].length, fresh) + self._spliced(kids[j], 0, stop - begins[j], [])
        self.opened += len(middle)
        return _above(self._merged(kids[:i] + middle + kids[j + 1 :], i, i + len(middle)))

    def _merged(self, kids: list[Node], first: int, stop: int) -> list[Node]:
        """Of the changed nodes from first to stop, one of few children goes together with a neighbour."""
        for k in range(stop - 1, first - 1, -1):
            if len(kids) > 1 and len(self._kids(kids[k])) < FAN // 4:
                a = max(0, k - 1)
                kids[a : a + 2] = _above(self._kids(kids[a]) + self._kids(kids[a + 1]))
        return kids

    def levels(self) -> list[Level]:
        """The tree as it is kept. Stretches that no edit opened are copied as they were stored."""
        if self.root is None:
            return []
        out: list[list[Level]] = [[] for _ in range(self.root.height + 1)]

        def walk(node: Node) -> None:
            if node.kids is None and node.at >= 0:
                a, b = node.at, node.at + 1
                for h in range(node.height, -1, -1):
                    out[h].append(tuple(x[a:b] for x in self.stored[h]))
                    if h:
                        a, b = int(self.first[h][a]), int(self.first[h][b])
                return
            kids = node.kids or []
            out[node.height].append(([len(kids)] if node.height else [], [node.length], [node.tokens]))
            for kid in kids:
                walk(kid)

        walk(self.root)
        return [tuple(np.concatenate(x).astype(np.int32) for x in zip(*parts)) for parts in out]


class Counter:
    def __init__(self, path: str) -> None:
        self.encoder = encoder(path)
        if self.encoder.pattern is None:
            raise ValueError("no pre-token boundaries are known for this vocabulary")

    def _leaves(self, text: str, begin: int, finder, stops) -> tuple[list[tuple[int, int]], int]:
        """The leaves from begin up to the first pre-token at which ``stops`` holds, or the end; and where
        that is. White space that is no pre-token goes with what is before it."""
        starts, tokens, room, end = [], [], 0, len(text)
        for m in finder.finditer(text, begin):
            at = m.start()
            if stops and stops(at):
                end = at
                break
            if room <= 0:
                starts.append(at)
                tokens.append(0)
                room = SEGMENT
            room -= m.end() - at
            tokens[-1] += len(self.encoder.known[m[0]])
        if not starts:
            return ([(end - begin, 0)] if end > begin else []), end
        return [(b - a, t // 4) for a, b, t in zip([begin, *starts[1:]], [*starts[1:], end], tokens)], end

    def leaves(self, text: str) -> list[tuple[int, int]]:
        finder = self.encoder.finder(text)
        units = finder.findall(text)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        if not units or ends[-1] != len(text):  # white space that is no pre-token: places are needed
            return self._leaves(text, 0, finder, None)[0]
        tokens = np.cumsum(np.fromiter(map(len, map(self.encoder.known.__getitem__, units)), np.int64, len(units))) // 4
        cuts, begin = [], 0
        while begin < len(text):  # a leaf ends with the pre-token that brings it to SEGMENT
            cuts.append(min(int(np.searchsorted(ends, begin + SEGMENT)), len(units) - 1))
            begin = int(ends[cuts[-1]])
        return list(zip(*(np.diff(x[cuts], prepend=0).tolist() for x in (ends, tokens))))

    def build(self, text: str) -> Tree:
        return Tree.of_leaves(self.leaves(text))

    def edit(self, text: str, tree: Tree, start: int, stop: int, new: str) -> tuple[str, int]:
        """Replace text[start:stop]; the new text, and how many code points were encoded anew."""
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        after, begin = text[:start] + new + text[stop:], 0
        moved = len(after) - len(text)
        if tree.root and start > self.encoder.reach:
            begin, _ = tree.leaf_at(start - self.encoder.reach)
            if begin:
                begin, _ = tree.leaf_at(begin - 1)  # one segment before
        meet = stop  # the first old leaf from here on, found as the new text is cut
        if tree.root and stop < len(text):
            a, b = tree.leaf_at(stop)
            meet = a if a == stop else b

        def stops(at: int) -> bool:
            nonlocal meet
            while meet < min(at - moved, len(text)):
                _, meet = tree.leaf_at(meet)
            return meet == at - moved >= stop and meet < len(text)

        leaves, end = self._leaves(after, begin, self.encoder.pattern_around, stops)
        tree.splice(begin, end - moved, leaves)
        return after, end - begin


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _lists(parts: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    if all(isinstance(p, list) for p in parts):
        flat = np.fromiter(chain.from_iterable(parts), np.int32, ends[-1])
    else:
        flat = np.concatenate(parts).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _to_arrow(trees: list[list[Level]]) -> pa.ListArray:
    flat = [level for tree in trees for level in tree]
    columns = [_lists([level[i] for level in flat]) for i in range(3)]
    ends = np.cumsum([0, *map(len, trees)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=["kids", "lengths", "tokens"]))


def _from_arrow(column: pa.ListArray) -> list[list[Level]]:
    """Views of the batch: nothing is copied or made a Python object here."""
    inner = [column.values.field(i) for i in range(3)]
    offsets, values = [x.offsets.to_numpy() for x in inner], [x.values.to_numpy(zero_copy_only=False) for x in inner]
    at = column.offsets.to_numpy()
    return [[tuple(v[o[level] : o[level + 1]] for o, v in zip(offsets, values)) for level in range(a, b)] for a, b in zip(at, at[1:])]


def _tree_rows(path: str):
    def run(batches):
        for batch in batches:
            trees = [stacked(counter(path).leaves(t)) for t in batch.column("text").to_pylist()]
            totals = [t[-1][2][0] if t else 0 for t in trees]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), _to_arrow(trees), pa.array(totals, pa.int64())], names=["doc_id", "mark", "levels", "n_tokens"])

    return run


def build_trees(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, levels, n_tokens of every row: its tree, all levels, and the root's tokens. mark is
    xxhash64 of the text, null as empty. An empty text has no levels and 0 tokens; a long one has a
    leaf for each 256 code points or so. An empty table gives an empty table."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return map_arrow(spread(rows), _tree_rows(tokenizer_path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, levels {LEVELS_SCHEMA}, n_tokens long")


def _edit_rows(path: str):
    def run(batches):
        for batch in batches:
            levels, total, anew, opened, texts = [], [], [], [], []
            for text, stored, edits in zip(batch.column("text").to_pylist(), _from_arrow(batch.column("levels")), batch.column("edits").to_pylist()):
                tree, n = Tree.of_levels(stored), 0
                for e in edits or []:
                    text, m = counter(path).edit(text, tree, e["start"], e["stop"], e["replacement"] or "")
                    n += m
                texts.append(text)
                levels.append(tree.levels() if edits else stored)
                total.append(tree.total)
                anew.append(n)
                opened.append(tree.opened)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), pa.array(texts, pa.string()), _to_arrow(levels), *(pa.array(x, pa.int64()) for x in (total, anew, opened))],
                names=["doc_id", "n_tokens_before", "text", "levels", "n_tokens", "n_encoded", "n_opened"],
            )

    return run


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens_before, text, levels, n_tokens, n_encoded, n_opened: every row of docs after its edits.

    edits: doc_id, seq, start, stop, replacement; applied in the order of seq (null first), each to the
    text that the one before left, to all rows with that id; places outside a text are moved to its
    ends, a null replacement is empty, an edit without a start or stop is left out. Rows without edits
    come out as they were, with n_encoded 0; null ids have none. Rows that repeat an id and text share
    their tree. n_encoded counts the code points encoded anew, n_opened the nodes read or made: both
    grow with the edits and the logarithm of the text, not with the text. An empty table gives an
    empty table.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    kept = trees.dropDuplicates(["doc_id", "mark"]).select(F.col("doc_id").alias("t_id"), F.col("mark").alias("t_mark"), "levels", "n_tokens")
    own = edits.where("start IS NOT NULL AND stop IS NOT NULL").groupBy(F.col("doc_id").alias("e_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("edits"))
    # The trees are joined with their edits first: both are small beside the texts.
    with_edits = kept.join(own, F.col("t_id") == F.col("e_id"), "left").drop("e_id")
    joined = rows.join(with_edits, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("mark") == F.col("t_mark"))).drop("t_id", "t_mark", "mark")
    return map_arrow(
        joined, _edit_rows(tokenizer_path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens_before long, text string, levels {LEVELS_SCHEMA}, n_tokens long, n_encoded long, n_opened long"
    )


def revision_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A fixed revision of every document with an id: a heading before it, the middle twenty code
    points replaced, the last ten removed. Rows that share an id get the edits of the longest text."""
    size = F.length(text_of(text_col))
    rows = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(size).alias("n"))
    head, middle = "Revised.\n\n", " [changed] "
    half, n = F.floor(F.col("n") / 2) + len(head), F.col("n") + len(head) + len(middle)

    def one(seq, start, stop, replacement):
        places = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
        return F.struct(F.lit(seq).alias("seq"), *(x.cast("long").alias(c) for x, c in zip(places, ("start", "stop"))), F.lit(replacement).alias("replacement"))

    each = F.array(one(0, 0, 0, head), one(1, half, half + 20, middle), one(2, n - 30, n, ""))
    return rows.select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.seq", "e.start", "e.stop", "e.replacement")


def token_counts(docs: DataFrame, tokenizer_path: str, edits: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Build the trees of docs, keep them as a table, and apply edits (revision_edits by default). A null
    text counts as empty; a very long one is counted whole, in leaves; other columns are ignored."""
    trees = stage(build_trees(docs, tokenizer_path, id_col, text_col), "segment-trees")
    return apply_edits(docs, trees, revision_edits(docs, id_col, text_col) if edits is None else edits, tokenizer_path, id_col, text_col)
