"""Exact join of documents by the Jaccard similarity of their word shingles.

Jaccard distance is a metric, and a pivot tells two sets apart only if it shares
something with them: at distance one from a pivot all look alike. So a document
only meets pivots with which it has a rare shingle in common. In a global order by
frequency, linked sets share one of their first shingles (of a set of n, those one
more than a linked set may lack); the smallest document that has such a shingle there
is its pivot, and the documents with that pivot are its Voronoi region. Linked
documents thus have a region in common.

Every region is measured: the distances of its documents to the pivot. By the
triangle inequality two linked documents are at distances from the pivot that differ
by no more than the link distance. So a region falls into rings of twice that width,
and a document that is within it of the next ring is replicated there. Documents
linked with the pivot are connected; rings of connected documents alone need no more.
A region of ``LEAF_BYTES`` at most is sent once, to one task, and measured and joined
there. The sets of larger regions are set apart; these regions are measured in salted
blocks, so that one of any size is dealt over tasks. Their rings above that size get
several pivots at a time and fall into Voronoi cells, where a document is replicated to
every cell whose pivot is no farther than its nearest one by twice the link distance;
smaller rings and cells are joined by the same means within a task. A document that was
a pivot has met all of its region and leaves it, so the recursion ends.

Words are named by polynomials over a prime field at two points drawn anew for each
run, which no text can make collide (two words of n bytes have one name with a
probability of at most (n / 2**31)**2), shingles by mixing three such names, or as many
as they have words, to 64 bits. Links are decided by exact counts of names.

Documents with equal sets are one from the start. What the census sends is reduced
in each map task first, so a shingle that a third of all documents share costs a row
per task.

First, a census finds the sets that can have a link at all: a linked set lacks a
bounded share of a set's shingles, so one with more shingles that no other has is
alone. It looks at a part of the shingles, by hash, that is twice that share. The
order by frequency starts with that part, too, so only it has to be counted.

Defined cases: null and wordless texts have the empty set, are linked with
nothing and are their own component; null ids take no part in links and have a
null component; rows that share an id are one document; texts of fewer words than
a shingle have their whole sequence as one; an empty table has no result; other
columns of the input are kept or ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import apart, broadcasts, materialize, pack, small_batches, unpack
from tessera.llm.graph import components

#: Shingles that a map task holds before it reduces and emits them.
RUN_SHINGLES = 1 << 21
LOT_BYTES = 1 << 20
#: Bytes of shingles of a ring or cell that a task joins, and of a block that is measured.
LEAF_BYTES, BLOCK_BYTES = 1 << 20, 1 << 20
#: And of the pivots that a block meets at a time; of a region that does not shrink,
#: twice as many in each round as in the one before while copies are below the next.
PIVOT_BYTES, ROUND_BYTES = 2 << 20, 256 << 20
PIVOTS, LEAF = 8, 16
#: The share of a region's documents that a cell may have if it is to fall into cells.
MOST = 0.6
PRIME = (1 << 31) - 1

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x1D8E4E27C47D124F) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo ``PRIME``."""
    out, done, step = np.ones(n, dtype=U), 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(step) % U(PRIME)
        done, step = done + more, step * step % PRIME
    return out


def draw() -> tuple[int, int]:
    """Two points for the names of words."""
    return 2 + secrets.randbelow(PRIME - 3), 2 + secrets.randbelow(PRIME - 3)


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, words: int, points: tuple[int, int]):
        self.words, self.points = words, points
        self.tables = [powers(x, 64) for x in points]

    def names(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Names of words that lie one after the other in ``data`` with spaces between."""
        sizes = ends - starts
        if not len(sizes):
            return np.zeros(0, dtype=U)
        at = np.cumsum(sizes) - sizes
        own = np.arange(sizes.sum()) - np.repeat(at, sizes)  # place of a byte in its word
        if sizes.max() > len(self.tables[0]):
            self.tables = [powers(x, int(sizes.max())) for x in self.points]
        symbols = data[np.repeat(starts, sizes) + own] + U(1)
        # products have 39 bits, so the sum of a word that is not huge has 64 at most
        folded = (lambda x: x % U(PRIME)) if sizes.max() > 1 << 24 else (lambda x: x)
        a, b = (np.add.reduceat(folded(symbols * t[own]), at) % U(PRIME) for t in self.tables)
        return a << U(31) | b

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sets of the texts one after the other, and where each begins, and the
        end; the texts of one call are hashed together."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
        edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
        starts, ends = edge[::2], edge[1::2]
        h, n = self.names(data, starts, ends), self.words
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)])).tolist()
        x = self.mixed(h, n)  # windows over the edge of a text are left out below
        parts, sizes = [], [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = np.sort(x[a : b - n + 1]) if b - a >= n else self.mixed(h[a:b], b - a) if b > a else h[:0]
            parts.append(part)
            sizes.append(len(part))
        at, every = np.cumsum(sizes), np.concatenate(parts)
        new = np.append(True, every[1:] != every[:-1])[: len(every)]
        new[at[:-1][np.diff(at) > 0]] = True
        return every[new], np.append(0, np.cumsum(new))[at]

    @staticmethod
    def mixed(h: np.ndarray, k: int) -> np.ndarray:
        """A hash of every ``k`` neighbouring names."""
        x = np.full(max(0, len(h) - k + 1), k, dtype=U)
        for j in range(k if len(x) else 0):
            x = mix(x * U(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j])
        return x

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The set of each text."""
        flat, at = self.flat(texts)
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def prefix_size(n, num: int, den: int):
    """One more than the shingles that a set linked with one of ``n`` may lack of it."""
    return n + num * n // -den + 1


def _lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held > LOT_BYTES:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


#: What a run sends to the task that has a range of shingles: packed columns.
CENSUS = "part int, kind int, " + ", ".join(f"x{k} binary" for k in range(5))
SHINGLES, CREDITS, DOCUMENTS = 0, 1, 2


def _leads(keys: list[np.ndarray], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and documents in order, where a key begins, and its smallest document."""
    k, i = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((i, k))
    k, i = k[order], i[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    return k, i, new, i[np.flatnonzero(new)][np.cumsum(new) - 1]


def _looked_at(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the census looks at a shingle: by hash, at twice the share that two
    linked sets can differ in."""
    return mix(s, 31) < U(min(2 * (den - num) * (1 << 64) // den, (1 << 64) - 1))


def _sampled(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The part of a set that the census looks at."""
    return s[_looked_at(s, num, den)]


def _credits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents, and how many of their sampled shingles are elsewhere, too."""
    return np.unique(ids, return_counts=True)


def _census(words: int, points: tuple[int, int], num: int, den: int, parts: int):
    """Packed rows: of documents (ids, two columns of their sets' names, sizes, numbers
    of sampled shingles); of sampled shingles of a run, each with one set of the run
    (steps between the shingles, ids, whether more sets of the run have it); what more
    sets have is credited (ids, counts). Shingles go to tasks by range."""

    def row(part: int, kind: int, *columns: np.ndarray) -> tuple:
        return part % parts, kind, *map(pack, columns), *[b""] * (5 - len(columns))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["part", "kind", *(f"x{k}" for k in range(5))])

    def emit(keys: list[np.ndarray], ids: list[np.ndarray]) -> pd.DataFrame:
        k, i, new, _ = _leads(keys, ids)
        last, out = np.append(new[1:], True), []
        if not (new & last).all():
            out.append(row(int(i[0]), CREDITS, *_credits(i[~(new & last)])))
        k, i, more = k[new], i[new], (~last[new]).astype(np.int64)
        cuts = np.searchsorted((k >> U(32)) * U(parts) >> U(32), np.arange(parts + 1, dtype=U)).tolist()
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                out.append(row(part, SHINGLES, np.diff(k[a:b], prepend=U(0)), i[a:b], more[a:b]))
        return frame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, keys, ids, held = Shingler(words, points), [], [], 0
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            doc_ids = batch["id"].to_numpy(dtype=np.int64)
            names = np.zeros((2, len(texts)), dtype=np.int64)
            sizes, looked = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            spoken: dict[tuple, list] = {}
            for a, b in _lots(texts):
                flat, at = shingler.flat(texts[a:b])
                sizes[a:b] = np.diff(at)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                for k in (0, 1):
                    names[k, a + full] = np.add.reduceat(mix(flat, k + 1), at[full]).view(np.int64)
                taken = np.append(0, np.cumsum(_looked_at(flat, num, den)))[at]
                looked[a:b] = np.diff(taken)
                sample = _sampled(flat, num, den)
                # of equal sets the smallest document speaks: the one that will stand for all
                for j in full.tolist():
                    i, name = int(doc_ids[a + j]), (int(names[0, a + j]), int(names[1, a + j]), int(sizes[a + j]))
                    if name in spoken:
                        spoken[name][0] = min(spoken[name][0], i)
                    else:
                        spoken[name] = [i, sample[taken[j] : taken[j + 1]]]
            if spoken:
                keys += [x for _, x in spoken.values()]
                each = [len(x) for _, x in spoken.values()]
                ids.append(np.repeat(np.array([i for i, _ in spoken.values()], dtype=np.int64), each))
                held += sum(each)
            if held > RUN_SHINGLES:
                yield emit(keys, ids)
                keys, ids, held = [], [], 0
            if len(doc_ids):
                yield frame([row(int(doc_ids[0]), DOCUMENTS, doc_ids, *names, sizes, looked)])
        if held:
            yield emit(keys, ids)

    return run


def _credit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each document a row (a, b and c: its set's name; n: 2 + its size) and a row
    (a, b: the sampled shingles of the set, n: -1); shingles that more than one run has
    are credited to the documents that were alone with them in theirs, in rows
    (a, b: how many, n: 1)."""
    keys, ids, shared = [], [], []

    def rows(a: np.ndarray, b: np.ndarray, c, n) -> pd.DataFrame:
        return pd.DataFrame({"a": a, "b": b, "c": c, "n": n})

    for batch in batches:
        for kind, x0, x1, x2, x3, x4 in zip(batch["kind"], *(batch[f"x{k}"] for k in range(5))):
            if kind == SHINGLES:
                keys.append(np.cumsum(unpack(x0, U)))
                ids.append(unpack(x1, np.int64))
                shared.append(unpack(x2, np.int64) > 0)
            elif kind == CREDITS:
                yield rows(unpack(x0, np.int64), unpack(x1, np.int64), 0, 1)
            else:
                a = unpack(x0, np.int64)
                yield rows(a, unpack(x1, np.int64), unpack(x2, np.int64), 2 + unpack(x3, np.int64))
                yield rows(a, unpack(x4, np.int64), 0, -1)
    if not keys:
        return
    k, i, credited = np.concatenate(keys), np.concatenate(ids), np.concatenate(shared)
    order = np.argsort(k, kind="stable")
    k, i, credited = k[order], i[order], credited[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    more = ~(new & np.append(new[1:], True)) & ~credited
    if more.any():
        yield rows(*_credits(i[more]), 0, 1)


def _sets(words: int, points: tuple[int, int]):
    """(id, n, hashes) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words, points)
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            for a, b in _lots(texts):
                sets = shingler.sets(texts[a:b])
                yield pd.DataFrame({"id": batch["id"].iloc[a:b].to_numpy(), "n": [len(s) for s in sets], "hashes": [s.tobytes() for s in sets]})

    return run


def _first_shingles(num: int, den: int):
    """(key, id, looked, wanted) of the sampled shingles of each set: how many they
    are and how many of them, the rarest, belong to its prefix. What a prefix needs
    beyond them comes by hash, with -1 as ``wanted``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, counts, held = [], [], 0
            for i, raw in zip(batch["id"].tolist(), batch["hashes"]):
                s = np.frombuffer(raw, dtype=U)
                part, need = _sampled(s, num, den), prefix_size(len(s), num, den)
                n = len(part)
                if n < need:
                    more = np.setdiff1d(s, part, assume_unique=True)[: need - n]
                    keys.append(more)
                    counts.append((i, n, -1, len(more)))
                keys.append(part)
                counts.append((i, n, min(need, n), n))
                held += n
                if held > RUN_SHINGLES:
                    yield rows(keys, counts)
                    keys, counts, held = [], [], 0
            if keys:
                yield rows(keys, counts)

    def rows(keys: list[np.ndarray], counts: list[tuple]) -> pd.DataFrame:
        i, n, wanted, each = np.array(counts, dtype=np.int64).T
        return pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "id": np.repeat(i, each), "looked": np.repeat(n, each), "wanted": np.repeat(wanted, each)})

    return run


class Region:
    """Shingle sets of a region as a sparse matrix, joined by pivots."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None):
        self.num, self.den, self.theta = num, den, 1 - num / den
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        vocabulary, self.columns = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(len(vocabulary), dtype=np.int32)
        # of members that are connected already, the first is the root
        self.root = list(range(len(sets))) if labels is None else np.unique(labels, return_index=True)[1][np.unique(labels, return_inverse=True)[1]].tolist()
        self.compared = self.excluded = 0  # distances computed; members that a window kept out of a cell

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def compare(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Distances of the pivot to the members; links are noted."""
        own = self.columns[self.starts[pivot] : self.starts[pivot + 1]]
        self.compared += len(members)
        self.mark[own] = 1
        sizes = self.size[members]
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(self.starts[members] - at[:-1], sizes) + np.arange(at[-1])
        both = np.add.reduceat(self.mark[self.columns[flat]], at[:-1])
        self.mark[own] = 0
        union = sizes + self.size[pivot] - both
        for x in members[self.den * both >= self.num * union].tolist():
            a, b = self.find(pivot), self.find(x)
            if a != b:
                self.root[max(a, b)] = min(a, b)
        return 1 - both / union

    def connected(self, members: np.ndarray) -> bool:
        first = self.find(int(members[0]))
        return all(self.find(x) == first for x in members.tolist())

    def parts(self) -> list[np.ndarray]:
        """Members that no link leads out of: each has its rarest shingles in the
        region, one more than it can lack of a linked one, and those that share one
        of these are together."""
        n, held = len(self.size), np.bincount(self.columns)
        doc = np.repeat(np.arange(n), self.size)
        order = np.lexsort((self.columns, held[self.columns], doc))
        prefix = prefix_size(self.size, self.num, self.den)
        keep = np.arange(len(doc)) - np.repeat(self.starts[:-1], self.size) < np.repeat(prefix, self.size)
        doc, column = doc[order][keep], self.columns[order][keep]
        label = np.arange(n)
        while True:
            low = np.full(len(held), n)
            np.minimum.at(low, column, label[doc])
            new = label.copy()
            np.minimum.at(new, doc, low[column])
            new = new[new]
            if (new == label).all():
                break
            label = new
        by = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[by])) + 1
        return [x for x in np.split(by, cuts) if len(x) > 1]

    def ringed(self, pivot: int, todo: list[np.ndarray]) -> list[np.ndarray]:
        """``todo`` dealt by rings around a pivot, which meets all members and leaves;
        two of them whose distances differ by ``theta`` at most have a ring in common."""
        members = np.delete(np.arange(len(self.size)), pivot)
        if not len(members):
            return []
        distance = np.insert(self.compare(pivot, members), pivot, np.nan)
        width, out = 2 * self.theta, []
        for part in todo:
            part = part[part != pivot]
            own, place = distance[part], np.floor(distance[part] / width)
            near = own >= (place + 1) * width - self.theta - 1e-9
            for ring in np.unique(place):
                inside = (place == ring) | (near & (place == ring - 1))
                self.excluded += int((~inside).sum())
                if inside.sum() > 1:
                    out.append(part[inside])
        return out

    def join(self, pivot: int | None = None) -> list[int]:
        """The smallest connected member of each; a pivot parts the members first."""
        todo = self.parts()
        if pivot is not None:
            todo = self.ringed(pivot, todo)
        while todo:
            members = todo.pop()
            while len(members) > LEAF and not self.connected(members):
                # pivots from as many components as there are, by size
                roots = np.array([self.find(x) for x in members.tolist()])
                _, firsts = np.unique(roots, return_index=True)
                order = members[firsts[np.argsort(self.size[members[firsts]], kind="stable")]]
                pivots = order[np.unique(np.linspace(0, len(order) - 1, PIVOTS).astype(int))]
                distances = np.stack([self.compare(int(p), members) for p in pivots])
                rest = ~np.isin(members, pivots)  # a pivot has met all members
                members, distances = members[rest], distances[:, rest]
                if not len(members):
                    break
                inside = distances <= distances.min(axis=0) + 2 * self.theta + 1e-9
                if inside.sum() < 1.5 * len(members):
                    self.excluded += int((~inside).sum())
                    todo += [members[cell] for cell in inside[1:] if cell.sum() > 1]
                    members = members[inside[0]]
                    if not len(members):
                        break
            if 1 < len(members) <= LEAF and not self.connected(members):
                for k in range(len(members) - 1):
                    self.compare(int(members[k]), members[k + 1 :])
        return [self.find(x) for x in range(len(self.size))]


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys``, group by group."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *new.tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and any(held[-1][k].iloc[0] != c[a] for k, c in zip(keys, columns)):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)


def _join_leaves(num: int, den: int):
    """Whole regions come one after the other, with their pivots where none has met them
    yet; links (a, b) that connect what no label did."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _grouped(batches, ["region"]):
            region = Region([np.frombuffer(x, dtype=U) for x in rows["hashes"]], num, den, rows["label"].to_numpy())
            before, ids = list(region.root), rows["id"].to_numpy()
            pivot = np.flatnonzero(ids == rows["region"].iloc[0])
            root = np.array(region.join(int(pivot[0]) if len(pivot) else None))
            new = root != before
            if new.any():
                yield pd.DataFrame({"a": ids[new], "b": ids[root[new]]})

    return run


def _measure(num: int, den: int, every: bool):
    """Blocks come one after the other, their pivots first; (region, id, pivot,
    distance, linked) for every document and pivot of a block, or for linked ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for rows in _grouped(batches, ["region", "block"]):
            n = int(rows["is_pivot"].sum())
            if n == len(rows):
                continue
            ids, sets, region = rows["id"].to_numpy(), [np.frombuffer(x, dtype=U) for x in rows["hashes"]], rows["region"].iloc[0]
            size = np.array([len(s) for s in sets[n:]])
            at = np.cumsum(size) - size
            known, column = np.unique(np.concatenate(sets[n:]), return_inverse=True)
            mark = np.zeros(len(known) + 1, dtype=np.int32)
            for pivot, own in zip(ids[:n].tolist(), sets[:n]):
                place = np.searchsorted(known, own)
                place = place[known[np.minimum(place, len(known) - 1)] == own]
                mark[place] = 1
                both = np.add.reduceat(mark[column], at)
                mark[place] = 0
                union = size + len(own) - both
                linked = den * both >= num * union
                take = slice(None) if every else linked
                told = ids[n:][take]
                out.append((np.full(len(told), region), told, np.full(len(told), pivot), (1 - both / union)[take], linked[take]))
                held += len(told)
            if held > 50_000:
                yield frame(out)
                out, held = [], 0
        if out:
            yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(["region", "id", "pivot", "distance", "linked"], map(np.concatenate, zip(*out)))))

    return run


def _measured(spark: SparkSession, members: DataFrame, pivots: DataFrame, sets: DataFrame, num: int, den: int, every: bool = True) -> DataFrame:
    """Distances of the members (region, id) to the pivots (region, id) of their
    region, in blocks of about ``BLOCK_BYTES``; a block has a copy for every
    ``PIVOT_BYTES`` or so of the pivots."""
    count = lambda rows, each, name: rows.join(sets.select("id", "n"), "id").groupBy("region").agg(F.ceil(F.sum("n") * 8 / each).cast("int").alias(name))
    sizes = count(members, BLOCK_BYTES, "blocks").join(count(pivots, PIVOT_BYTES, "lots"), "region")
    block, lot = F.pmod(F.xxhash64("id"), F.col("blocks")), F.pmod(F.xxhash64("id"), F.col("lots"))
    own = members.join(sizes, "region").select("region", "id", F.explode(F.transform(F.sequence(F.lit(0), F.col("lots") - 1), lambda x: (block * F.col("lots") + x).cast("int"))).alias("block"))
    own = own.join(sets, "id").select("region", "block", F.lit(False).alias("is_pivot"), "id", "hashes")
    places = pivots.join(sizes, "region").select("region", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x * F.col("lots") + lot).cast("int"))).alias("block"), "id")
    asked = places.join(sets, "id").select("region", "block", F.lit(True).alias("is_pivot"), "id", "hashes")
    dealt = own.unionAll(asked).repartition("region", "block").sortWithinPartitions("region", "block", F.desc("is_pivot"), "id")
    return dealt.mapInPandas(_measure(num, den, every), "region bigint, id bigint, pivot bigint, distance double, linked boolean")


def regions_of(spark: SparkSession, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(region, id): the pivots that each document meets. Linked documents have one
    in common; a pivot is in its own region."""
    first = materialize(spark, sets.select("id", "hashes").mapInPandas(_first_shingles(num, den), "key bigint, id bigint, looked bigint, wanted bigint"), "jaccard-first")
    counted = first.where("wanted >= 0")
    often = counted.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = counted.join(often, "key")
    own = Window.partitionBy("id")
    # the shingles that no other set has come first in the order and make no region
    alone = F.col("looked") - F.count(F.lit(1)).over(own)
    ranked = shared.select("key", "id", (F.col("wanted") - alone).alias("left"), F.row_number().over(own.orderBy("often", "key")).alias("place"))
    prefix = ranked.where("place <= left").select("key", "id").unionAll(first.where("wanted < 0").select("key", "id"))
    prefix = materialize(spark, prefix, "jaccard-prefix")
    lead = prefix.groupBy("key").agg(F.min("id").alias("region"), F.max("id").alias("last")).where("region < last").select("key", "region")
    return prefix.join(lead, "key").select("region", "id").distinct()


def rings(measured: DataFrame, theta: float) -> DataFrame:
    """(region, id): each region's rings around its pivot. Documents whose distances
    differ by ``theta`` at most have a ring in common."""
    width = 2 * theta
    ring = F.floor(F.col("distance") / width).cast("int")
    near = F.col("distance") >= (ring + 1) * width - theta - 1e-9
    own = F.explode(F.when(near, F.array(ring, ring + 1)).otherwise(F.array(ring)))
    return measured.select("region", "id", own.alias("ring")).select(F.xxhash64("region", "ring").alias("region"), "id")


def cells(measured: DataFrame, theta: float) -> DataFrame:
    """(region, id, shrinks): the Voronoi cells of a region's pivots, with the documents
    that may be linked with one inside; a region that would not shrink stays whole.
    The pivots have met all and leave."""
    rest = measured.join(measured.select("region", F.col("pivot").alias("id")).distinct(), ["region", "id"], "left_anti")
    near = F.min("distance").over(Window.partitionBy("region", "id"))
    inside = rest.withColumn("near", near).where(F.col("distance") <= F.col("near") + 2 * theta + 1e-9)
    # where one cell keeps most, many rounds would split off a little each
    whole = rest.groupBy("region").agg(F.count_distinct("id").alias("n"))
    each = inside.groupBy("region", "pivot").count().groupBy("region").agg(F.sum("count").alias("all"), F.max("count").alias("most"))
    shrink = each.join(whole, "region").select("region", ((F.col("all") < 1.5 * F.col("n")) & (F.col("most") <= MOST * F.col("n"))).alias("shrinks"))
    return inside.join(shrink, "region").select(F.when(F.col("shrinks"), F.xxhash64("region", "pivot")).otherwise(F.col("region")).alias("region"), "id", "shrinks").distinct()


def _open(spark: SparkSession, regions: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """(region, id, label) of the regions whose documents are not all connected."""
    found = components(spark, links).select(F.col("node").alias("id"), "label")
    rows = materialize(spark, regions.drop("label").join(found, "id", "left").withColumn("label", F.coalesce("label", "id")), label)
    more = rows.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("region")
    return materialize(spark, rows.join(more, "region", "left_semi"), label)


def _swept(spark: SparkSession, regions: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links with those of regions (region, id, label) that no pivots split: what
    is outside the largest component of a region meets all of it, as pivots of
    ``PIVOT_BYTES`` or so in the first round and more in the next ones, and leaves."""
    share = PIVOT_BYTES
    while not regions.isEmpty():
        main = regions.groupBy("region", "label").count().groupBy("region").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        outside = materialize(spark, regions.join(main, "region").where("label <> main").join(sets.select("id", "n"), "id").select("region", "id", "n"), "jaccard-outside")
        # copies of pivots for all blocks are within ROUND_BYTES, or those of PIVOT_BYTES
        most = _sized(regions, sets).select("region", F.least(F.lit(float(share)), F.greatest(F.lit(float(PIVOT_BYTES)), F.lit(float(ROUND_BYTES)) * BLOCK_BYTES / F.col("bytes"))).alias("share"))
        lots = outside.join(most, "region").groupBy("region").agg(F.ceil(F.sum("n") * 8 / F.max("share")).alias("lots"), F.min_by("id", F.xxhash64("id")).alias("one"))
        # one at least, so that every round brings the end nearer
        mine = (F.pmod(F.xxhash64("id"), F.col("lots")) == 0) | (F.col("id") == F.col("one"))
        pivots = materialize(spark, outside.join(lots, "region").where(mine).select("region", "id").distinct(), "jaccard-pivots")
        new = _measured(spark, regions.select("region", "id"), pivots, sets, num, den, every=False).where("id <> pivot")
        links = materialize(spark, links.unionAll(new.select(F.col("id").alias("a"), F.col("pivot").alias("b"))), "jaccard-links")
        regions = _open(spark, regions.join(pivots, ["region", "id"], "left_anti"), links, "jaccard-swept")
        share = min(2 * share, ROUND_BYTES)
    return links


def _linked(leaves: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of whole regions (region, id, label), each within a task."""
    dealt = leaves.join(sets.select("id", "hashes"), "id").select("region", "id", "label", "hashes").repartition("region").sortWithinPartitions("region", "id")
    return dealt.mapInPandas(_join_leaves(num, den), "a bigint, b bigint")


def _sized(regions: DataFrame, sets: DataFrame) -> DataFrame:
    return regions.join(sets.select("id", "n"), "id").groupBy("region").agg((F.sum("n") * 8).alias("bytes"))


def join_sets(spark: SparkSession, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, label) of the documents of ``sets`` (id, n, hashes) that have a link."""
    theta = 1 - num / den
    members = materialize(spark, regions_of(spark, sets, num, den), "jaccard-regions")
    large = materialize(spark, _sized(members, sets).where(F.col("bytes") > LEAF_BYTES).select("region"), "jaccard-large")
    # most regions are small; their sets are sent once
    small = members.join(large, "region", "left_anti").withColumn("label", F.col("id"))
    links = materialize(spark, _linked(small, sets, num, den), "jaccard-links")
    if large.isEmpty():
        return components(spark, links)
    members = materialize(spark, members.join(large, "region", "left_semi"), "jaccard-regions")
    ids = materialize(spark, members.select(F.col("id").alias("m_id")).distinct(), "jaccard-large-ids")
    wanted = F.broadcast(ids) if broadcasts(ids.count(), 64) else ids
    sets = materialize(spark, sets.join(wanted, F.col("id") == F.col("m_id"), "left_semi"), "jaccard-large-sets")
    pivots = members.select("region", F.col("region").alias("id")).distinct()
    measured = materialize(spark, _measured(spark, members, pivots, sets, num, den), "jaccard-measured")
    links = materialize(spark, links.unionAll(measured.where("linked and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))), "jaccard-links")
    regions = _open(spark, rings(measured, theta), links, "jaccard-rings")
    leaves = []
    while True:
        large = materialize(spark, _sized(regions, sets).where(F.col("bytes") > LEAF_BYTES).select("region"), "jaccard-large")
        if large.isEmpty():
            leaves.append(regions)
            break
        leaves.append(regions.join(large, "region", "left_anti"))
        regions = regions.join(large, "region", "left_semi")
        # pivots of different components, where there are any
        slot = F.pmod(F.xxhash64("label"), F.lit(PIVOTS))
        pivots = materialize(spark, regions.groupBy("region", slot.alias("slot")).agg(F.min_by("id", F.xxhash64("id")).alias("id")).select("region", "id"), "jaccard-pivots")
        measured = materialize(spark, _measured(spark, regions.select("region", "id"), pivots, sets, num, den), "jaccard-measured")
        new = measured.where("linked and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        links = materialize(spark, links.unionAll(new), "jaccard-links")
        found = _open(spark, cells(measured, theta), links, "jaccard-cells")
        links = _swept(spark, found.where("not shrinks").drop("shrinks"), links, sets, num, den)
        regions = found.where("shrinks").drop("shrinks")
    whole = leaves[0]
    for more in leaves[1:]:
        whole = whole.unionAll(more)
    return components(spark, links.unionAll(_linked(whole, sets, num, den)))


def join_documents(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row; two documents are linked when
    den * |intersection| >= num * |union|, and ``component_id`` is the smallest id
    that links lead to."""
    small_batches(spark)
    points = draw()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = texts.where(F.col("id").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    census = known.mapInPandas(_census(words, points, num, den, parts), CENSUS).repartitionById(parts, F.col("part")).mapInPandas(_credit, "a bigint, b bigint, c bigint, n int")
    census = materialize(spark, census, "jaccard-census")
    rows = census.where("n >= 2").select(F.col("a").alias("id"), (F.col("n") - 2).alias("n_shingles"), F.col("b").alias("s1"), F.col("c").alias("s2"))
    # equal sets: named by their smallest document
    equal = rows.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    again = equal.where("copies > 1").drop("copies")
    named = rows.join(again, ["s1", "s2", "n_shingles"], "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"))
    named = materialize(spark, named, "jaccard-named")
    # a set with more shingles of its own than a linked one can lack has no link
    elsewhere = census.where("n = 1").groupBy(F.col("a").alias("e_id")).agg(F.sum("b").alias("elsewhere"))
    looked = census.where("n = -1").groupBy(F.col("a").alias("l_id")).agg(F.max("b").alias("looked"))
    own = F.col("looked") - F.coalesce("elsewhere", F.lit(0))
    maybe = named.where("rep = id and n_shingles > 0").groupBy("id").agg(F.max("n_shingles").alias("n")).join(looked, F.col("id") == F.col("l_id")).join(elsewhere, F.col("id") == F.col("e_id"), "left").where(own * den <= F.col("n") * (den - num)).select(F.col("id").alias("m_id"))
    maybe = materialize(spark, maybe, "jaccard-maybe")
    wanted = F.broadcast(maybe) if broadcasts(maybe.count(), 64) else maybe
    sets = known.join(wanted, F.col("id") == F.col("m_id")).select("id", "text").mapInPandas(_sets(words, points), "id bigint, n int, hashes binary")
    sets = materialize(spark, sets, "jaccard-sets")
    found = join_sets(spark, sets, num, den).where("label <> node").select(F.col("node").alias("rep"), F.col("label").alias("component"))
    out = named.join(found, "rep", "left").select("id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    unknown = texts.where(F.col("id").isNull()).mapInPandas(_sets(words, points), "id bigint, n int, hashes binary")
    none = unknown.select("id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionAll(none).withColumnRenamed("id", id_col)


def without_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document, the smallest id, of each component."""
    found = join_documents(spark, docs, id_col=id_col, text_col=text_col, **options)
    gone, of = apart(docs, found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("id")).distinct())
    return docs.join(gone, F.col(id_col) == of("id"), "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 90 * (x.n + y.n - both_n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
