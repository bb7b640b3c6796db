"""SentencePiece encoding and decoding by a Viterbi pass over an Aho-Corasick automaton.

The automaton holds every piece.  A text is read once; at each place the output links give
all pieces that end there, longest first, and each relaxes the best score of the place.
Characters without a piece fall back to their UTF-8 bytes.

For unigram models the best path is the answer.  In models of merged pairs (BPE, like the
public 32k vocabulary) a path is admissible only if every two neighbours are what merging
their joined text gives; exactly one path is, so the same pass returns the library's ids.

Where no piece continues a word across a space mark, a text falls apart into space-led
words, and those into segments wherever no piece holds the two characters that meet.  A task
remembers the ids of the words and segments it has met, up to a number of characters, and
forgets them at its end; only speed depends on that.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

MARK = "▁"
#: Words whose ids, and pairs whose admissibility, a task remembers; those of the generation before stay at hand.
MEMORY = 150_000
#: Longer words are not remembered.
LONGEST = 40
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
BPE = 2


@dataclass
class Vocabulary:
    """Pieces of a model with scores and kinds, in id order, and what the encoder must know of the model."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    merged: bool
    prefix: bool

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("pieces", "scores", "kinds", "merged", "prefix")}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def __post_init__(self) -> None:
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.has_bytes = BYTE in self.kinds
        whole = any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.words = re.compile(".+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.raw = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k in (NORMAL, USER) else b"" if k != UNKNOWN else " ⁇ ".encode()
            for p, k in zip(self.pieces, self.kinds)
        ]
        self.inner = {a + b for p in self.id_of for a, b in zip(p, p[1:])}
        self.forget()
        self.split: list[tuple[int, int] | None] = [None] * len(self.pieces)
        self._automaton()

    def forget(self) -> None:
        """Drop what was remembered."""
        self.pairs, self.memory, self.older = {}, {}, {}

    def _automaton(self) -> None:
        """Goto, failure and output links; ``ends[s]`` is the piece that ends in state ``s`` or -1."""
        self.goto, self.ends, depth = [{}], [-1], [0]
        for piece, i in self.id_of.items():
            state = 0
            for c in piece:
                nxt = self.goto[state].get(c)
                if nxt is None:
                    nxt = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.ends.append(-1)
                    depth.append(depth[state] + 1)
                state = nxt
            self.ends[state] = i
        self.fail, self.link, self.depth = [0] * len(self.goto), [0] * len(self.goto), depth
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for c, nxt in self.goto[state].items():
                back = self.fail[state]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                back = self.goto[back].get(c, 0) if state else 0
                self.fail[nxt] = back if back != nxt else 0
                self.link[nxt] = self.fail[nxt] if self.ends[self.fail[nxt]] >= 0 else self.link[self.fail[nxt]]
                queue.append(nxt)
        # Steps that follow failure links, and what the output links of a state lead to, written out on first use.
        self.step: list[dict[str, int]] = [dict(x) for x in self.goto]
        self.outputs: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.goto)

    def _next(self, state: int, c: str) -> int:
        """The state after ``c``; characters that no piece has lead to the start and are not written out."""
        back = state
        while back and c not in self.goto[back]:
            back = self.fail[back]
        back = self.goto[back].get(c, 0)
        if c in self.goto[0] or back:
            self.step[state][c] = back
        return back

    def _output(self, state: int) -> tuple[tuple[int, int], ...]:
        """Pieces that end in a state with their lengths, longest first."""
        found, out = [], state if self.ends[state] >= 0 else self.link[state]
        while out:
            found.append((self.ends[out], self.depth[out]))
            out = self.link[out]
        self.outputs[state] = tuple(found)
        return self.outputs[state]

    def halves(self, piece: int) -> tuple[int, int]:
        """The two pieces whose merge makes ``piece`` when its text stands alone: (-1, -1) for a single
        character, (-2, -2) for a piece that merging never makes."""
        known = self.split[piece]
        if known is None:
            parts, known = list(self.pieces[piece]), (-1, -1)
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    i = self.id_of.get(parts[k] + parts[k + 1])
                    if i is not None and (best is None or self.scores[i] > best):
                        best, at = self.scores[i], k
                if best is None:
                    known = (-2, -2)
                    break
                known = tuple(self.id_of.get(x, -1) for x in parts[at : at + 2])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[piece] = known
        return known

    def admissible(self, before: int, piece: int) -> bool:
        """Whether two neighbours (``before`` is -1 at the start or after a character without a piece) may stand.

        The merges of both are undone, the latest first.  Each time, the two parts that touch
        stood side by side until the merge that was undone; had their own merge come first
        (a better score, or the same further left), the two pieces would not have come about.
        """
        if len(self.pairs) >= 2 * MEMORY:
            self.pairs.clear()
        known = self.halves(piece)[0] != -2
        if known and before >= 0:
            a, b, scores, id_of, pieces = before, piece, self.scores, self.id_of, self.pieces
            bound, or_equal = float("-inf"), False
            while True:
                joined = id_of.get(pieces[a] + pieces[b])
                if joined is not None and (scores[joined] > bound or or_equal and scores[joined] == bound):
                    known = False
                    break
                left, right = self.halves(a)[1], self.halves(b)[0]
                if left >= 0 and (right < 0 or scores[a] < scores[b]):
                    bound, or_equal, a = scores[a], False, left
                elif right >= 0:
                    bound, or_equal, b = scores[b], True, right
                else:
                    break
        self.pairs[before << 32 | piece] = known
        return known

    def viterbi(self, word: str) -> tuple[int, ...]:
        """Ids of one word in a single pass."""
        return self._ids(word, *(self._admissible_path(word) if self.merged else self._best_path(word)))

    def _admissible_path(self, word: str) -> tuple[list[int], list[int]]:
        """Last piece and its start for every beginning of the word in a model of merged pairs.

        One path at most is admissible, so the first piece that fits has the best score.
        """
        last, start = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        step, outputs, pairs = self.step, self.outputs, self.pairs
        state, at = 0, 0
        for c in word:
            at += 1
            nxt = step[state].get(c)
            state = self._next(state, c) if nxt is None else nxt
            found = outputs[state]
            for piece, size in self._output(state) if found is None else found:
                pair = last[at - size] << 32 | piece
                if pairs[pair] if pair in pairs else self.admissible(last[at - size], piece):
                    last[at], start[at] = piece, at - size
                    break
            else:
                start[at] = at - 1
        return last, start

    def _best_path(self, word: str) -> tuple[list[int], list[int]]:
        """As ``_admissible_path`` for a unigram model: every piece relaxes the score of the place where it ends."""
        low = float("-inf")
        best, last, start = [0.0] + [low] * len(word), [-1] * (len(word) + 1), [0] * (len(word) + 1)
        step, outputs, scores = self.step, self.outputs, self.scores
        state = 0
        for at, c in enumerate(word, 1):
            nxt = step[state].get(c)
            state = self._next(state, c) if nxt is None else nxt
            found = outputs[state]
            for piece, size in self._output(state) if found is None else found:
                if best[at - size] + scores[piece] > best[at]:
                    best[at], last[at], start[at] = best[at - size] + scores[piece], piece, at - size
            if best[at] == low and c not in self.id_of:
                best[at], last[at], start[at] = best[at - 1] - 1e6, -1, at - 1
        return last, start

    def _ids(self, word: str, last: list[int], start: list[int]) -> tuple[int, ...]:
        """Ids along the path that ends the word; a character without a piece becomes its bytes or the unknown piece."""
        ids: list[int] = []
        at = len(word)
        while at:
            if last[at] >= 0:
                ids.append(last[at])
            elif self.has_bytes:
                ids += [self.byte_ids[b] for b in reversed(word[start[at] : at].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.unknown)
            at = start[at]
        return tuple(reversed(ids))

    def _remember(self, word: str, ids: tuple[int, ...]) -> None:
        if len(word) <= LONGEST:
            if len(self.memory) >= MEMORY:
                self.older, self.memory = self.memory, {}
            self.memory[word] = ids

    def _segments(self, word: str) -> tuple[int, ...]:
        """Ids of a word: no piece holds the two characters at the border of two segments, so none is passed over."""
        inner = self.inner
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inner]
        if not cuts:
            return self.viterbi(word)
        ids: tuple[int, ...] = ()
        for a, b in zip([0, *cuts], [*cuts, len(word)]):
            segment = word[a:b]
            known = self.memory.get(segment) or self.older.get(segment)
            if known is None:
                known = self.viterbi(segment)
                self._remember(segment, known)
            ids += known
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; none for an empty one."""
        if not text:
            return []
        marked, ids = (" " * self.prefix + text).replace(" ", MARK), []
        for word in self.words.findall(marked):
            known = self.memory.get(word)
            if known is None:
                known = self.older.get(word) or (self._segments(word) if self.merged else self.viterbi(word))
                self._remember(word, known)
            ids += known
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """Text of the ids; control pieces have none, byte pieces join to UTF-8, the leading mark goes."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load(path: str) -> Vocabulary:
    """Read a model file on the driver; tasks get the pieces, never the path."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models without text normalisation are read")
    return Vocabulary(
        [p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces],
        model.trainer_spec.model_type == BPE, spec.add_dummy_prefix,
    )


def round_trip(docs: DataFrame, vocabulary: Vocabulary, *, texts: bool = True) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded, same`` of every row: encoded, decoded and compared in one pass.

    ``same`` is false only for texts that hold the space mark itself, which decodes to a space;
    NULL texts have NULL ids, 0 tokens and count as the same, empty ones no ids.  Without
    ``texts`` there is no ``decoded``.  Repeated rows repeat; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "ids", "same", *["decoded"] * texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        try:
            for batch in batches:
                for part in slices(batch, 2 << 20):
                    flat, ends, back, same = array("i"), [0], [], []
                    given = part.column(1).to_pylist()
                    for text in given:
                        ids = codec.encode(text or "")
                        flat.extend(ids)
                        ends.append(len(flat))
                        decoded = None if text is None else codec.decode(ids)
                        same.append(decoded == text)
                        if texts:
                            back.append(decoded)
                    missing = pa.array([t is None for t in given])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=missing)
                    columns = [part.column(0), ids, pa.array(same, pa.bool_()), *([pa.array(back, pa.string())] if texts else [])]
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            codec.forget()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = rows.mapInArrow(run, "doc_id long, ids array<int>, same boolean" + ", decoded string" * texts)
    return out.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))
