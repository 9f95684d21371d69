"""SentencePiece encoding and decoding with N-best segmentation.

All segmentations of a text into pieces form a lattice; a segmentation's score is the sum of its pieces' scores. A
forward Viterbi pass gives the best score from the start to each place. These are exact heuristics for an A* search
that runs backward from the end, so complete paths leave the queue in order of score: the first is the best, and the
search stops after N.

Scores are log-probabilities. A unigram model has them. A BPE model has merge ranks instead, which don't add up; Zipf's
law turns rank r into -log(r + OFFSET) - COST. Both constants were chosen once by agreement with the library's own
merges (81 % of running words are cut alike); no text is learned from.

Pieces never join a word to a blank after it, nor hold a character that no piece has, so the lattice falls apart at
those places. The Viterbi pass runs once for each distinct chunk between them, for many chunks at a time, and is
memoised with the least loss of leaving the chunk's best. The search runs over a whole text: a path in its queue has a
fixed end and takes the best from there to the text's start; where it can still leave that best it goes into the queue
again. Chunks beyond the N - 1 that lose least are not looked into, as none of the N best leaves its best there.
Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush, nsmallest
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import documents, importable, slices

BLANK = "▁"
OFFSET, COST = 10, 3.0
#: How much worse than the worst piece a character without a piece is.
UNKNOWN_PENALTY = 10
#: Chunks that go through the lattice at a time.
GROUP = 4096
#: Chunks up to this length go through the lattice in groups, longer ones one by one.
SHORT = 64
NONE = -np.inf


class Pieces:
    """A sentencepiece model's pieces as a lattice; a bounded memo of chunks."""

    CAP = 200_000
    #: Characters of the chunks that ``more`` holds, and of those whose lattices are kept for the ways searched next.
    HELD, OPEN = 100_000, 2_000

    def __init__(self, path: str, n_best: int = 4) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n, self.n_best = sp.get_piece_size(), n_best
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [bytes([int(self.text[i][3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else self.text[i].replace(BLANK, " ").encode() for i in range(n)]
        self.unk = sp.unk_id()
        self.id = {self.text[i]: i for i in range(n) if not special[i]}
        given = {p: sp.get_score(i) for p, i in self.id.items()}
        ranks = all(x == int(x) for x in given.values()) and min(given.values()) < -n // 2
        self.score = {p: -float(np.log(min(-x, n) + OFFSET)) - COST for p, x in given.items()} if ranks else given
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece holds a blank behind another character")
        # a trie as sorted keys (node, character) with the node they lead to, and the piece that ends at a node
        prefixes = sorted({p[:k] for p in self.id for k in range(1, len(p) + 1)}, key=len)
        node = {"": 0} | {p: i for i, p in enumerate(prefixes, 1)}
        keys = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in prefixes], np.int64)
        order = keys.argsort()
        self.keys, self.child = keys[order], np.arange(1, len(prefixes) + 1)[order]
        tops = self.keys < 1 << 21
        self.root = np.zeros(int(self.keys[tops].max()) + 2, np.int64)
        self.root[self.keys[tops]] = self.child[tops]
        self.inner = np.zeros(len(prefixes) + 1, bool)
        self.inner[self.keys >> 21] = True
        self.ends = np.array([-1] + [self.id.get(p, -1) for p in prefixes], np.int32)
        self.weight = np.array([self.score.get(p, 0.0) for p in self.text])
        self.starts = {p: self.score.get(p) for p in prefixes}
        plain = "".join(re.escape(c) for c in sorted({c for p in self.id for c in p} - {BLANK}))
        self.plain = {c for p in self.id for c in p} | {BLANK}
        self.chunks = re.compile(f"{BLANK}*[{plain}]+|{BLANK}+|[^{BLANK}{plain}]").findall
        self.odd = re.compile(f"[^{BLANK}{plain}]")
        # the memo: chunk -> place in the columns below (score, least loss, number of ids and the ids of its best, times met)
        self.memo: dict[str, int] = {}
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.n, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.begin, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, ...]] = []
        self.more: dict[tuple, tuple] = {}
        self.open: dict[str, tuple] = {}
        self.held = 0

    def normal(self, text: str) -> str:
        """Blanks become visible, one more goes in front; nothing else changes."""
        return BLANK + text.replace(" ", BLANK) if text else ""

    def cut(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The chunks of texts: (distinct chunks, which of them each chunk is, number of chunks by text).

        A sign that no text holds is put where ``chunks`` cuts, and Arrow splits there.
        """
        texts = [self.normal(t or "") for t in texts]
        sign = next(x for x in map(chr, chain(range(0x20), range(0xE000, 0xF900), range(0xF0000, 0x110000))) if x not in self.plain and not any(x in t for t in texts))
        odd = f"{sign}\\g<0>{sign}"
        marked = [sign.join(self.chunks(t)) if BLANK + BLANK in t else self.odd.sub(odd, t).replace(BLANK, sign + BLANK) for t in texts]
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), sign)
        row, every = pc.list_parent_indices(lists), lists.flatten()
        keep = pc.not_equal(every, "")
        every = every.filter(keep).dictionary_encode()
        return every.dictionary.to_numpy(zero_copy_only=False).tolist(), every.indices.to_numpy(), np.bincount(row.filter(keep).to_numpy(), minlength=len(texts))

    def edges(self, c: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, piece ids) of all pieces in the characters c; what starts at i ends at stop[i] at the latest."""
        at, node, length = np.arange(len(c)), np.zeros(len(c), np.int64), 0
        while True:
            inside = (at + length < stop[at]) & self.inner[node]
            at, node = at[inside], node[inside]
            if not len(at):
                return
            if length:
                key = node << 21 | c[at + length]
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[i] == key
                at, node = at[known], self.child[i[known]]
            else:
                node = self.root[np.minimum(c, len(self.root) - 1)]
                at, node = at[node > 0], node[node > 0]
            length += 1
            piece = self.ends[node]
            yield length, at[piece >= 0], piece[piece >= 0]

    def lattice(self, s: str) -> tuple[list[float], list[list[tuple[int, str, float]]]]:
        """(best score from the start to each place, pieces that end at each place as (start, piece, score)) of one chunk."""
        n, starts = len(s), self.starts
        ends: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
        if n <= SHORT:
            for i in range(n):
                for j in range(i + 1, n + 1):
                    w = starts.get(p := s[i:j], 0)
                    if w == 0 and p not in starts:
                        break
                    if w is not None:
                        ends[j].append((i, p, w))
        else:
            for length, at, piece in self.edges(np.array([ord(x) for x in s], np.int64), np.full(n, n)):
                for i, k, w in zip(at.tolist(), piece.tolist(), self.weight[piece].tolist(), strict=True):
                    ends[i + length].append((i, self.text[k], w))
        best = [0.0] + [NONE] * n
        for j in range(1, n + 1):
            if not any(i == j - 1 for i, _, _ in ends[j]):  # no piece is this character
                ends[j].append((j - 1, s[j - 1], self.unknown))
            best[j] = max([best[i] + w for i, _, w in ends[j]])
        return best, ends

    def follow(self, lattice: tuple, at: int, path: tuple | None, most: int) -> tuple[bytes, list[tuple[float, int, tuple]]]:
        """Backward from place ``at`` of a chunk, ``path`` being its pieces from there on, along the best to the start.

        Returns the ids of the whole way and the ways that leave it at a place, as (loss, place, path): the ``most`` that
        lose least. Of equal ways the one with the shorter last piece is the best.
        """
        best, ends = lattice
        off: list[tuple[float, int, tuple]] = []
        while at:
            arcs = sorted([(best[at] - (best[i] + w), -i, p) for i, p, w in ends[at]])
            off += [(loss, -i, (p, path)) for loss, i, p in arcs[1 : most + 1]]
            path, at = (arcs[0][2], path), -arcs[0][1]
        pieces = []
        while path:
            pieces.append(path[0])
            path = path[1]
        return self.ids(pieces), nsmallest(most, off, key=lambda x: x[0])

    def turns(self, chunk: str, key: tuple[int, ...], at: int, path: tuple | None, most: int) -> tuple[bytes, list[tuple[float, int, tuple]]]:
        """``follow`` with a memo; key: which way was taken each time that the path so far left the best, last piece first."""
        got = self.more.get((chunk, most, key))
        if got is None:
            self.held += len(chunk)
            if self.held > self.HELD:
                self.more.clear()
                self.held = len(chunk)
            lattice = self.open.get(chunk)
            if lattice is None:
                if sum(map(len, self.open)) + len(chunk) > self.OPEN:
                    self.open.clear()
                lattice = self.open[chunk] = self.lattice(chunk)
            got = self.more[chunk, most, key] = self.follow(lattice, at, path, most)
        return got

    def paths(self, part: Callable[[int], str], loss: np.ndarray, n_best: int) -> list[tuple[float, dict[int, bytes]]]:
        """The n best paths through the lattice of a text, best first: (score lost, ids of the chunks that leave their best).

        The search runs backward from the end of the text. What is in the queue has a fixed end and takes the best from its
        place to the start, whose score the forward pass gives exactly; so what leaves the queue first is complete at once,
        and only the places where it can still leave the best go into the queue. ``part`` gives a chunk by its place in the
        text, ``loss`` the least that leaving costs in each: chunks beyond the n - 1 least are in none of the n best.
        """
        out: list[tuple[float, dict[int, bytes]]] = []
        most, count = n_best - 1, 0
        where = range(len(loss)) if len(loss) <= most else np.argpartition(loss, most - 1)[:most].tolist() if most else []
        where = {i: part(i) for i in sorted(where) if loss[i] < np.inf}
        queue: list[tuple] = [(0.0, 0, len(loss), (), 0, None, {})]
        while queue and len(out) < n_best:
            lost, _, i, key, at, path, used = heappop(queue)
            off = []
            if key:
                ids, off = self.turns(where[i], key, at, path, most)
                before, used = used, {**used, i: ids}
                off = [(lost + x, i, (*key, k), j, way, before) for k, (x, j, way) in enumerate(off)]
            out.append((lost, used))
            for c, chunk in where.items():
                if c < i:
                    off += [(lost + x, c, (k,), j, way, used) for k, (x, j, way) in enumerate(self.turns(chunk, (), len(chunk), None, most)[1])]
            for x, *way in off:
                count += 1
                heappush(queue, (x, count, *way))
            if len(queue) > 4 * n_best:  # every path in the queue ends with the score it promises, so n_best of them are enough
                queue = nsmallest(n_best - len(out), queue)
        return out

    def ids(self, pieces: list[str]) -> bytes:
        """Piece ids as int32; a character without a piece as its bytes."""
        out = array("i")
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte_id.get(b, self.unk) for b in p.encode("utf-8", "replace"))
        return out.tobytes()

    def _one(self, chunk: str) -> tuple[float, bytes, float]:
        """(score, ids of the best, least that leaving it costs) of one chunk."""
        lattice = self.lattice(chunk)
        ids, off = self.follow(lattice, len(chunk), None, 1)
        return lattice[0][-1], ids, off[0][0] if off else np.inf

    def _group(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``_one`` gives, for many chunks at a time: (scores, losses, numbers of ids, ids one after the other).

        Pieces that start at the same place of their chunks end at different places, so all of them go at once.
        """
        n, lens = len(chunks), np.array([len(c) for c in chunks])
        c = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(lens) - lens
        row = np.repeat(np.arange(n), lens)
        got = list(self.edges(c, (first + lens)[row]))
        lone = np.ones(len(c), bool)
        lone[got[0][1] if got else []] = False  # characters without a piece
        lone = np.flatnonzero(lone)
        start = np.concatenate([lone, *(at for _, at, _ in got)])
        which = np.concatenate([np.full(len(lone), -1, np.int32), *(k for _, _, k in got)])
        length = np.repeat([1, *(x for x, _, _ in got)], [len(lone), *(len(at) for _, at, _ in got)])
        place = (start - first[row[start]]).astype(np.uint8)
        order = place.argsort(kind="stable")
        start, which, length = start[order], which[order], length[order]
        src = start + row[start]  # a chunk has one place more than characters
        dst = src + length
        w = np.where(which < 0, self.unknown, self.weight[which])
        best, second, back = (np.full(len(c) + n, x, t) for x, t in ((NONE, float), (NONE, float), (-1, np.int64)))
        origin = first + np.arange(n)
        best[origin] = 0.0
        at = 0
        for end in np.cumsum(np.bincount(place)).tolist():
            to = dst[at:end]
            new, old = best[src[at:end]] + w[at:end], best[to]
            better = new >= old
            second[to] = np.maximum(second[to], np.where(better, old, new))
            best[to] = np.where(better, new, old)
            back[to[better]] = np.flatnonzero(better) + at
            at = end
        last = origin + lens
        gap, loss = best - second, np.full(n, np.inf)
        on, at, steps = np.arange(n), last, []
        while len(on):
            loss[on] = np.minimum(loss[on], gap[at])
            e = back[at]
            steps.append((on, which[e]))
            at = src[e]
            more = at != origin[on]
            on, at = on[more], at[more]
        on, ids = (np.concatenate([x[i] for x in steps[::-1]]) for i in range(2))
        order = on.astype(np.uint16).argsort(kind="stable")
        return best[last], loss, np.bincount(on, minlength=n), ids[order]

    def learn(self, chunks: list[str]) -> None:
        """Puts score, least loss and ids of each chunk's best into the memo."""
        short = [c for c in chunks if len(c) <= SHORT]
        for at in range(0, len(short), GROUP):
            group = short[at : at + GROUP]
            score, loss, n, ids = self._group(group)
            odd = set(np.repeat(np.arange(len(group)), n)[ids < 0].tolist())
            if odd:
                ends = np.cumsum(n)
                single = [np.frombuffer(self._one(c)[1], np.int32) if i in odd else ids[e - k : e] for i, (c, e, k) in enumerate(zip(group, ends.tolist(), n.tolist(), strict=True))]
                n, ids = np.array([len(x) for x in single]), np.concatenate(single)
            self._keep(group, score, loss, n, ids)
        for c in chunks:
            if len(c) > SHORT:
                score, ids, loss = self._one(c)
                self._keep([c], np.array([score]), np.array([loss]), np.array([len(ids) // 4]), np.frombuffer(ids, np.int32))

    def _keep(self, chunks: list[str], score: np.ndarray, loss: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        self.memo.update(zip(chunks, range(len(self.memo), len(self.memo) + len(chunks)), strict=True))
        self.new.append((score, loss, n, ids))

    def _settle(self) -> None:
        """Columns of the memo, with what was learned since."""
        if self.new:
            score, loss, n, ids = (np.concatenate([x[i] for x in ((self.best, self.loss, self.n, self.flat), *self.new)]) for i in range(4))
            self.best, self.loss, self.n, self.flat = score, loss, n.astype(np.int32), ids.astype(np.int32)
            self.hits = np.concatenate([self.hits, np.zeros(len(score) - len(self.hits), np.int64)])
            self.begin, self.new = np.cumsum(self.n, dtype=np.int64) - self.n, []

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the chunks ``at``, one after the other."""
        n = self.n[at].astype(np.int64)
        return self.flat[np.arange(n.sum()) + np.repeat(self.begin[at] - (np.cumsum(n) - n), n)]

    def _shrink(self) -> None:
        """Half of the memo goes: the chunks met least often, older meetings counting less."""
        names = list(self.memo)
        at = np.sort(np.argpartition(-self.hits, self.CAP // 2)[: self.CAP // 2]) if len(names) > self.CAP // 2 else np.arange(len(names))
        flat = self._gather(at)
        self.best, self.loss, self.n, self.hits, self.flat = self.best[at], self.loss[at], self.n[at], self.hits[at] // 2, flat
        self.begin = np.cumsum(self.n, dtype=np.int64) - self.n
        self.memo = {names[i]: k for k, i in enumerate(at.tolist())}

    def places(self, chunks: list[str]) -> np.ndarray:
        """Where the memo has each of the chunks, which are distinct; what it lacks is learned."""
        at = list(map(self.memo.get, chunks))
        new = [c for c, i in zip(chunks, at, strict=True) if i is None]
        if len(self.memo) + len(new) > self.CAP and self.memo:
            self._shrink()
            new = [c for c in chunks if c not in self.memo]
        if new:
            self.learn(new)
            self._settle()
            at = list(map(self.memo.__getitem__, chunks))
        return np.array(at, np.int64)

    def batch(self, texts: list[str | None], n_best: int) -> Iterator[tuple[float, np.ndarray, list[tuple[float, dict[int, bytes]]], np.ndarray]]:
        """For each text (score of the best, its ids, its paths as of ``paths``, numbers of ids of its chunks)."""
        names, which, count = self.cut(texts)
        places = self.places(names)
        self.hits[places] += np.bincount(which, minlength=len(names))
        at = places[which]
        ids, n, loss, score = self._gather(at), self.n[at], self.loss[at], self.best[at]
        stop = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        j = 0
        for k in count.tolist():
            i, j = j, j + k
            own = which[i:j]
            yield float(score[i:j].sum()), ids[stop[i] : stop[j]], self.paths(lambda x, own=own: names[own[x]], loss[i:j], n_best), n[i:j]

    def search(self, s: str, n_best: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of s, blanks being visible, best first: (score, ids as int32 bytes); ties in order of discovery."""
        parts = self.chunks(s)
        names = list(dict.fromkeys(parts))
        place = dict(zip(names, self.places(names).tolist(), strict=True))
        at = np.array([place[c] for c in parts], np.int64)
        total, every = float(self.best[at].sum()), [self._gather(at[i : i + 1]).tobytes() for i in range(len(at))]
        return [(total - lost, b"".join([used.get(i, x) for i, x in enumerate(every)])) for lost, used in self.paths(parts.__getitem__, self.loss[at], n_best)]

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The n best encodings of a text, best first: (score, ids as int32 bytes)."""
        return self.search(self.normal(text), self.n_best)

    def decode(self, ids: bytes) -> str:
        """The text of piece ids; bytes are joined before they are read."""
        raw = self.raw
        out = b"".join(map(raw.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_MODELS: dict[tuple[str, int], Pieces] = {}
SCHEMA = "ids array<int>, n_tokens long, score double, other_scores array<double>, other_tokens array<int>, ids_crc32 long, decodes boolean"


def encode(docs: DataFrame, vocabulary: str, n_best: int = 4) -> DataFrame:
    """The columns of docs but text, then SCHEMA, for each row of docs (text and any others).

    ids: the best segmentation; other_scores and other_tokens: scores and lengths of the next best, best first;
    decodes: the ids give back the text (false only where the text itself holds the model's blank sign). Null and
    empty texts have no ids and score 0. Columns that SCHEMA names are replaced.
    """
    importable(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    keep = [c for c in docs.columns if c != "text" and c not in names]
    fields = [f for f in docs.schema.fields if f.name in keep]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (vocabulary, n_best) not in _MODELS:
            _MODELS[vocabulary, n_best] = Pieces(vocabulary, n_best)
        model = _MODELS[vocabulary, n_best]
        for b in slices(batches):
            best, n, score, scores, tokens, crc, ok = [], [], [], [], [], [], []
            texts = b.column(b.num_columns - 1).to_pylist()
            for t, (total, got, ways, lens) in zip(texts, model.batch(texts, n_best), strict=True):
                ids = got.tobytes()
                best.append(ids)
                n.append(len(got))
                score.append(total)
                scores.append([total - lost for lost, _ in ways[1:]])
                tokens.append([len(got) + sum(len(x) // 4 - int(lens[i]) for i, x in used.items()) for _, used in ways[1:]])
                crc.append(zlib.crc32(ids))
                ok.append(model.decode(ids) == (t or ""))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(best), np.int32)))
            new = [lists, pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(tokens, pa.list_(pa.int32())), pa.array(crc, pa.int64()), pa.array(ok)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *new], [*keep, *names])

    from pyspark.sql.types import StructType

    schema = StructType([*fields, *StructType.fromDDL(SCHEMA).fields])
    return docs.select(*[docs[c] for c in keep], docs["text"]).mapInArrow(rows, schema)


def op3_pieces(spark, sf_dir):
    """piece_bpe_32k.model, 4 best."""
    import public_tokenizers

    return encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), 4)
