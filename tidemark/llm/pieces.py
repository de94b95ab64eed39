"""SentencePiece encoding and decoding with exact N-best segmentations.

A text becomes the piece sequence of the highest total score (the vocabulary
file's piece scores), with the next best ones beside it. Forward Viterbi gives
every position its best score; those are exact heuristics for a backward A*
search, which pops complete segmentations in order of score.

A piece never continues past the start of a space run or across a line feed, so
the lattice of a text is a chain of small lattices (chunks). The chunk
results are composed exactly: a chunk's loss from its best to its second-best
segmentation is known from forward and backward scores, only the ``n - 1``
chunks of smallest loss can differ in the ``n`` best texts, and A* runs
on those. Forward scores of distinct chunks are computed for many chunks at once.

Spaces are written as U+2581 after one leading space, as SentencePiece does;
characters outside the vocabulary, U+2581 itself included, become byte
pieces, so decoding returns the text exactly.

Order of segmentations: higher score first; equal scores within a chunk by longer last
piece, then longer last but one, and so on; equal scores of texts by the
earlier segmentation in the last chunk in which they differ.

Edge cases: null and empty texts have no pieces, score 0 and one segmentation; a
text may have fewer than ``n`` segmentations; chunks longer than ``WIDE``
characters (whole texts without spaces) take a linear one-by-one path; repeated rows each get
their own row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, small_batches, text_of

N_BEST = 4
SPACE = "▁"
WIDE = 24            # characters of a chunk in the many-at-once path
CACHE = 500_000      # chunks a worker remembers (when full it keeps the older half, where the frequent ones are)
STEP = 1 << 18       # characters processed at a time
CACHE_CHARS = 8 << 20  # characters of these chunks
ROWS = 8_000         # chunks whose forward scores are computed at once


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and byte pieces of a model file; trie transitions."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.scores = scores
        self.ids = {p: i for i, p in enumerate(pieces) if p and i not in self.byte_of}
        self.unknown = min(scores) - 10.0  # a character written in byte pieces
        self.longest = max(map(len, self.ids))
        loose = any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and len(p) > 1) for p in self.ids)
        self.chunk = re.compile(r"(?s).+" if loose else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self._build_trie()

    def _build_trie(self) -> None:
        chars = sorted({c for p in self.ids for c in p})
        self.n_chars = len(chars) + 1  # 0: a character that is in no piece
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        top = max(map(ord, chars)) + 2
        self.code_table = np.zeros(top, np.int32)
        self.code_table[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        edges: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for p, i in self.ids.items():
            node = 0
            for ch in p:
                key = (node, self.code[ch])
                if key not in edges:
                    edges[key] = len(piece_at)
                    piece_at.append(-1)
                node = edges[key]
            piece_at[node] = i
        keys = np.array([a * self.n_chars + c for a, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.next = np.array(list(edges.values()), np.int64)[order]
        self.piece_at = np.array(piece_at, np.int64)
        self.score_at = np.array([self.scores[i] if i >= 0 else 0.0 for i in piece_at])

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next trie node, -1 where there is none."""
        key = state * self.n_chars + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (code > 0), self.next[at], -1)

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (char if char != "\x00" else SPACE).encode("utf-8", "surrogatepass")]


def load_vocabulary(path: str | None = None) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model_path())
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    known = set(byte_ids)
    return Vocabulary(["" if special[i] else sp.id_to_piece(i) for i in range(n)],
                      [0.0 if special[i] or i in known else float(sp.get_score(i)) for i in range(n)], byte_ids)


def escape(text: str) -> str:
    """Spaces as U+2581 after a leading one. A literal U+2581 becomes U+0000, a literal
    U+0000 a private character, each of which is in no piece (see ``unescape``)."""
    if not text:
        return ""
    if SPACE in text or "\x00" in text or "" in text:
        text = text.replace("", "b").replace("\x00", "a").replace(SPACE, "\x00")
    return SPACE + text.replace(" ", SPACE)


def forward(v: Vocabulary, s: str) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
    """Best score of each prefix, and for each end the edges (length, id, score)."""
    n, ids, scores = len(s), v.ids, v.scores
    alpha = [0.0] + [-np.inf] * n
    ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        a = alpha[i]
        for d in range(1, min(v.longest, n - i) + 1):
            p = ids.get(s[i:i + d])
            if p is None:
                if d > 1:
                    continue
                p, w = len(v.pieces) + ord(s[i]), v.unknown
            else:
                w = scores[p]
            ends[i + d].append((d, p, w))
            if a + w > alpha[i + d]:
                alpha[i + d] = a + w
    return alpha, ends


class _Path:
    """A partial segmentation, from the end of the chunk to ``at``, as a linked list.

    Orders by priority, then by the lengths from the end (longer first, a path before
    its extensions). Jump pointers find where two paths part in logarithmic time,
    so long chunks with many equal scores stay linear in memory.
    """

    __slots__ = ("priority", "score", "at", "piece", "parent", "jump", "depth")

    def __init__(self, priority: float, score: float, at: int, piece: int, parent):
        self.priority, self.score, self.at, self.piece, self.parent = priority, score, at, piece, parent
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            j = parent.jump
            self.depth = parent.depth + 1
            self.jump = j.jump if parent.depth - j.depth == j.depth - j.jump.depth else parent

    def up_to(self, depth: int):
        x = self
        while x.depth > depth:
            x = x.jump if x.jump.depth >= depth else x.parent
        return x

    def __lt__(self, other) -> bool:
        if self.priority != other.priority:
            return self.priority > other.priority
        depth = min(self.depth, other.depth)
        a, b = self.up_to(depth), other.up_to(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.at < b.at  # from the same place, the longer piece


def n_best(v: Vocabulary, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations (score, edge ids) of a chunk, in order.

    Backward A*: the priority of a partial path from the end is its score plus the
    forward score of where it stands, which no completion can exceed and
    one attains. Paths that leave the best one for the first time at different edges
    differ, so the (n - 1)-th smallest of their losses bounds what must be kept.
    """
    alpha, ends = forward(v, s)
    losses, at, g = [], len(s), 0.0
    while at:
        d, _, w = max((e for e in ends[at] if alpha[at - e[0]] + e[2] == alpha[at]), key=lambda e: e[0])
        losses += [alpha[at] - alpha[at - e[0]] - e[2] for e in ends[at] if e[0] != d]
        at, g = at - d, g + w
    floor = alpha[-1] - sorted(losses)[n - 2] if 2 <= n <= len(losses) + 1 else -np.inf if n > 1 else alpha[-1]
    floor -= 1e-12 * abs(floor)
    heap, out = [_Path(alpha[-1], 0.0, len(s), -1, None)], []
    while heap and len(out) < n:
        x = heapq.heappop(heap)
        if x.at == 0:
            path, node = [], x
            while node.parent is not None:
                path.append(node.piece)
                node = node.parent
            out.append((x.score, tuple(path)))
            continue
        for d, p, w in ends[x.at]:
            f = x.score + w + alpha[x.at - d]
            if f >= floor:
                heapq.heappush(heap, _Path(f, x.score + w, x.at - d, p, x))
    return out


def _best_one(v: Vocabulary, s: str) -> tuple[float, float, tuple[int, ...]]:
    """(best score, loss of the second best or inf, edge ids of the best), in linear time."""
    alpha, ends = forward(v, s)
    beta, path, at, on = [-np.inf] * len(s) + [0.0], [], len(s), set()
    for j in range(len(s), 0, -1):
        for d, _, w in ends[j]:
            beta[j - d] = max(beta[j - d], w + beta[j])
    while at:
        d, p, _ = max((e for e in ends[at] if alpha[at - e[0]] + e[2] == alpha[at]), key=lambda e: e[0])
        path.append(p)
        on.add((at, d))
        at -= d
    loss = min((alpha[-1] - (alpha[j - d] + w + beta[j]) for j in range(1, len(s) + 1)
                for d, _, w in ends[j] if (j, d) not in on), default=np.inf)
    return alpha[-1], loss, tuple(path[::-1])


def _best_many(v: Vocabulary, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_best_one`` for many short chunks: positions and lengths are looped over,
    chunks are not. Edge ids come flat, in chunk order, with a count per chunk."""
    n = len(chunks)
    size = np.fromiter(map(len, chunks), np.int64, n)
    order = np.argsort(-size, kind="stable")
    size, wide = size[order], int(size.max())
    points = np.zeros((n, wide), np.uint32)
    flat = np.frombuffer("".join([chunks[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32)
    points[np.arange(wide)[None, :] < size[:, None]] = flat
    code = np.where(points < len(v.code_table), v.code_table[np.minimum(points, len(v.code_table) - 1)], 0).astype(np.int64)
    alpha = np.full((n, wide + 1), -np.inf)
    alpha[:, 0] = 0
    back = np.zeros((n, wide + 1), np.int64)
    piece = np.zeros((n, wide + 1), np.int64)
    edges = []
    longer = np.searchsorted(-size, -np.arange(wide + 1), side="left")  # rows longer than i come first
    for i in range(wide):
        rows = np.arange(longer[i])
        state = np.zeros(len(rows), np.int64)
        for d in range(1, min(v.longest, wide - i) + 1):
            if d > 1:
                keep = rows < longer[i + d - 1]
                rows, state = rows[keep], state[keep]
            if len(rows) == 0:
                break
            state = v.step(state, code[rows, i + d - 1])
            if d == 1:
                got = np.where(state >= 0, v.piece_at[state], -1)
                ids = np.where(got >= 0, got, len(v.pieces) + points[rows, i])
                r, w = rows, np.where(got >= 0, v.score_at[state], v.unknown)
                live = state >= 0
                rows, state = rows[live], state[live]
            else:
                live = state >= 0
                rows, state = rows[live], state[live]
                full = v.piece_at[state] >= 0
                r, ids, w = rows[full], v.piece_at[state[full]], v.score_at[state[full]]
            if len(r):
                edges.append((i, d, r, w))
                total = alpha[r, i] + w
                up = total > alpha[r, i + d]
                ru = r[up]
                alpha[ru, i + d], back[ru, i + d], piece[ru, i + d] = total[up], d, ids[up]
    every = np.arange(n)
    best = alpha[every, size]
    beta = np.full((n, wide + 1), -np.inf)
    beta[every, size] = 0
    for i, d, r, w in reversed(edges):
        beta[r, i] = np.maximum(beta[r, i], w + beta[r, i + d])
    on = np.zeros((n, wide + 1), bool)
    at, rows = size.copy(), every
    while len(rows):
        on[rows, at[rows]] = True
        at[rows] -= back[rows, at[rows]]
        rows = rows[at[rows] > 0]
    loss = np.full(n, np.inf)
    for i, d, r, w in edges:
        off = ~(on[r, i + d] & (back[r, i + d] == d))
        ro = r[off]
        loss[ro] = np.minimum(loss[ro], best[ro] - (alpha[ro, i] + w[off] + beta[ro, i + d]))
    undo = np.empty(n, np.int64)
    undo[order] = every
    on, piece = on[undo], piece[undo]
    return best[undo], loss[undo], piece[on], on.sum(1)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, runs after one another."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts; remembers chunk results between texts, up to ``CACHE`` chunks."""

    def __init__(self, v: Vocabulary, n: int = N_BEST):
        self.v, self.n = v, n
        self.is_byte = np.zeros(len(v.pieces), bool)
        self.is_byte[v.byte_ids] = True
        self.more: dict[str, list] = {}
        self._forget()

    def _forget(self, keep: int = 0) -> None:
        """Only the first ``keep`` chunks stay."""
        if keep:
            self.slot = dict(islice(self.slot.items(), keep))
            self.chars = sum(map(len, self.slot))
            self.used = int(self.start[keep - 1] + self.length[keep - 1])
            return
        self.slot: dict[str, int] = {}
        self.chars = 0
        self.used = 0  # of ``flat``
        self.best, self.loss = np.zeros(1024), np.zeros(1024)
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)

    def _piece_ids(self, path) -> list[int]:
        top, out = len(self.v.pieces), []
        for p in path:
            if p < top:
                out.append(p)
            else:
                out += self.v.bytes_of(chr(p - top))
        return out

    def _store(self, chunks: list[str], best, loss, flat, length) -> None:
        """Edge ids as piece ids (characters in no piece spelled in bytes) in new slots."""
        if len(flat) and flat.max() >= len(self.v.pieces):
            owner = np.repeat(np.arange(len(chunks)), length)
            odd = np.flatnonzero(flat >= len(self.v.pieces))
            spelled = [self.v.bytes_of(chr(c - len(self.v.pieces))) for c in flat[odd].tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = [len(x) for x in spelled]
            owner = np.repeat(owner, times)
            wide = np.repeat(flat, times)
            wide[_spread((np.cumsum(times) - times)[odd], times[odd])] = [b for x in spelled for b in x]
            flat, length = wide, np.bincount(owner, minlength=len(chunks))
        lo, hi = len(self.slot), len(self.slot) + len(chunks)
        for name in ("best", "loss", "start", "length"):
            setattr(self, name, _room(getattr(self, name), hi))
        self.flat = _room(self.flat, self.used + len(flat))
        self.best[lo:hi], self.loss[lo:hi], self.length[lo:hi] = best, loss, length
        self.start[lo:hi] = self.used + np.cumsum(length) - length
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.slot.update(zip(chunks, range(lo, hi)))
        self.chars += sum(map(len, chunks))

    def _learn(self, chunks) -> None:
        short = sorted((c for c in chunks if len(c) <= WIDE), key=len, reverse=True)
        for at in range(0, len(short), ROWS):
            some = short[at:at + ROWS]
            self._store(some, *_best_many(self.v, some))
        for c in chunks:
            if len(c) > WIDE:
                best, loss, path = _best_one(self.v, c)
                self._store([c], best, loss, np.array(path, np.int64), np.array([len(path)]))

    def _alternatives(self, chunk: str) -> list[tuple[float, list[int]]]:
        got = self.more.get(chunk)
        if got is None:
            found = n_best(self.v, chunk, self.n)
            got = [(found[0][0] - s, self._piece_ids(p)) for s, p in found]
            if len(self.more) > CACHE // 64:
                self.more.clear()
            self.more[chunk] = got
        return got

    def encode_all(self, texts: list[str]):
        """Per text: (ids of the best, its score, [(score, {chunk place: ids})] of all found)."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STEP):
                size += len(texts[end])
                end += 1
            split = [self.v.chunk.findall(escape(t)) for t in texts[at:end]]
            every = set().union(*split)
            new = every.difference(self.slot)
            if new:
                if self.chars > CACHE_CHARS:
                    self._forget()
                    new = every
                elif len(self.slot) + len(new) > CACHE:
                    self._forget(min(len(self.slot), CACHE // 2))
                    new = every.difference(self.slot)
                self._learn(new)
            for chunks in split:
                yield self._one(chunks)
            at = end

    def _one(self, chunks: list[str]):
        if not chunks:
            return np.zeros(0, np.int32), 0.0, [(0.0, {})]
        slots = np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))
        score, loss = float(self.best[slots].sum()), self.loss[slots]
        ids = self.flat[_spread(self.start[slots], self.length[slots])]
        k = self.n - 1
        finite = np.flatnonzero(np.isfinite(loss))
        if len(finite) > k:
            cut = np.partition(loss[finite], k - 1)[k - 1] if k else -1
            finite = finite[loss[finite] <= cut]
            finite = finite[np.lexsort((finite, loss[finite]))][:k]
        places = np.sort(finite).tolist()
        combos = [(0.0, ())]
        for place in places:
            options = self._alternatives(chunks[place])
            combos = sorted((lost + l, (j,) + rev) for lost, rev in combos for j, (l, _) in enumerate(options))[:self.n]
        found = [(score - lost, {p: self._alternatives(chunks[p])[j][1] for p, j in zip(places[::-1], rev) if j})
                 for lost, rev in combos]
        return ids, score, found

    def with_changes(self, text: str, changes: dict[int, list[int]]) -> list[int]:
        """The ids of a segmentation that differs from the best in some chunks."""
        chunks = self.v.chunk.findall(escape(text))
        self._learn(set(chunks) - self.slot.keys())
        out: list[int] = []
        for i, c in enumerate(chunks):
            at = self.slot[c]
            out += changes[i] if i in changes else self.flat[self.start[at]:self.start[at] + self.length[at]].tolist()
        return out

    def decode(self, ids: np.ndarray) -> str:
        return decode(self.v, ids.tolist(), bool(self.is_byte[ids].any()))


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a copy of twice the room, with at least ``n`` places."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def decode(v: Vocabulary, ids: list[int], with_bytes: bool | None = None) -> str:
    """Pieces joined, byte runs read as UTF-8, U+2581 as space, the leading space dropped."""
    pieces, byte_of = v.pieces, v.byte_of
    if not ids:
        return ""
    if with_bytes is False or (with_bytes is None and byte_of.keys().isdisjoint(ids)):
        text = "".join(map(pieces.__getitem__, ids)).replace(SPACE, " ")
    else:
        raw, run = [], bytearray()
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                raw.append(run.decode("utf-8", "surrogatepass"))
                run = bytearray()
            raw.append(pieces[i].replace(SPACE, " "))
        raw.append(run.decode("utf-8", "surrogatepass"))
        text = "".join(raw)
    text = text[1:]
    if "" in text:
        text = text.replace("a", "\x00").replace("b", "")
    return text


def _small(batches):
    return small_batches(batches, STEP)


def _encoded(docs: DataFrame, model_path: str | None, n: int, full: bool) -> DataFrame:
    spark = docs.sparkSession
    ready(spark)
    held = spark.sparkContext.broadcast(load_vocabulary(model_path))  # the model file's pieces: fixed size

    def run(batches):
        v = held.value
        coder = Encoder(v, n)
        for batch in _small(batches):
            texts = batch.column("text").to_pylist()
            cols: dict[str, list] = {k: [] for k in ("n_pieces", "score", "best_scores", "same", "sha", "ids")}
            for text, (ids, score, found) in zip(texts, coder.encode_all(texts)):
                cols["n_pieces"].append(len(ids))
                cols["score"].append(score)
                cols["best_scores"].append([s for s, _ in found])
                cols["same"].append(coder.decode(ids) == text)
                if full:
                    cols["ids"].append(ids)
                else:
                    cols["sha"].append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
            last = pa.array(cols["ids"], pa.list_(pa.int32())) if full else pa.array(cols["sha"], pa.string())
            yield pa.record_batch([batch.column("doc_id"), pa.array(cols["n_pieces"], pa.int64()), pa.array(cols["score"], pa.float64()),
                                   pa.array(cols["best_scores"], pa.list_(pa.float64())), pa.array(cols["same"], pa.bool_()), last],
                                  names=["doc_id", "n_pieces", "score", "best_scores", "round_trip", "ids" if full else "ids_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_pieces long, score double, best_scores array<double>, round_trip boolean, "
        + ("ids array<int>" if full else "ids_sha256 string"))


def encode(docs: DataFrame, model_path: str | None = None, n: int = N_BEST) -> DataFrame:
    """Per row: doc_id, n_pieces, score, best_scores (of up to ``n``
    segmentations, best first), round_trip (decoding gives the text), ids."""
    return _encoded(docs, model_path, n, True)


def encode_digest(docs: DataFrame, model_path: str | None = None, n: int = N_BEST) -> DataFrame:
    """``encode`` with ``ids_sha256`` (ids as little-endian int32) in place of ids."""
    return _encoded(docs, model_path, n, False)


def decode_ids(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are read as none."""
    spark = encoded.sparkSession
    ready(spark)
    held = spark.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches):
        for batch in batches:
            texts = [decode(held.value, ids) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(
        run, "doc_id long, text string")
