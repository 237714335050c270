"""SentencePiece encoding and decoding by a forward pass over a trie of words.

A text is marked as the model does it (blanks become the mark, one mark in front) and cut into
marked words: a run of marks and what follows up to the next mark. No piece of the model crosses such a border, so
the words can be encoded one by one. The distinct new words of a batch are sorted, which lays out
their trie; it is walked depth-first, and the forward state of each prefix is worked out once and
kept while words share it. The pieces that end at a prefix come from the pieces' own trie, whose nodes
link to their next shorter ends (as in Aho-Corasick), so a character takes one step.

The forward state of a prefix is its best path's last piece:

* unigram models: the classical Viterbi score, the sum of the pieces' log probabilities;
* BPE models: a path scores 0 if each two neighbours on it stay apart when their joint text is encoded
  alone, else minus infinity. Exactly one path does, and it is the merge result, so the ids equal
  the library's.

Characters outside the vocabulary become byte pieces (or the unknown piece if the model has none).
Decoding joins the pieces' bytes, puts blanks for marks and takes off the one in front.

Scale: rows are independent, there is no shuffle. A task keeps a bounded cache of words (two generations) and lets it go at its end. The model
file is read by each task from ``path``, which every machine must have.

Defined cases: null and empty texts have no ids; very long words and texts are encoded whole;
``decoded`` of a text equals the text unless it holds the mark U+2581 itself, which the model cannot tell
from a blank (``round_trip`` says so); repeated rows are repeated; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words after which an encoder starts a new memory within a task, keeping the one before (about 60 MB for both), pairs of
#: pieces that it remembers (about 35 MB) and steps out of the pieces' trie that it remembers (about 30 MB).
_CACHE, _PAIRS, _STEPS = 100_000, 400_000, 300_000
#: Characters of neighbouring words that are compared for all words at once.
_HEAD = 24
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces, scores and kind of a SentencePiece model file."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids: dict[str, int] = {}
        self.scores: list[float] = [sp.get_score(i) for i in range(n)]
        self.bytes = {}
        self.raw: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(p.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    self.ids[p] = i
        self.bpe = _model_kind(path) == 2
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0


def _model_kind(path: str) -> int:
    """``trainer_spec.model_type`` of the model file (1 unigram, 2 BPE), read from its fields."""
    with open(path, "rb") as f:
        data = f.read()

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return value, at
            shift += 7

    def fields(at, end):
        while at < end:
            tag, at = varint(at)
            if tag & 7 == 0:
                value, at = varint(at)
                yield tag >> 3, value, at
            elif tag & 7 == 2:
                size, at = varint(at)
                yield tag >> 3, (at, at + size), at + size
                at += size
            else:
                at += 8 if tag & 7 == 1 else 4

    for number, value, _ in fields(0, len(data)):
        if number == 2:
            for inner, kind, _ in fields(*value):
                if inner == 3 and isinstance(kind, int):
                    return kind
    return 1


class _Node(dict):
    """A node of the pieces' trie by next character; as a state, the longest end of what was read that can still grow.

    ``ends`` are the pieces that end here as ``(length, piece)``, longest first; ``shorter`` is the next shorter end that can grow (none: the root).
    ``spare`` counts down the steps that may still be kept besides the trie's own.
    """

    __slots__ = ("shorter", "ends", "spare")

    def __init__(self, spare: list[int]):
        self.shorter, self.ends, self.spare = None, (), spare

    def __missing__(self, char: str) -> _Node:
        state = self
        while state.shorter is not None:
            state = state.shorter
            if char in state:
                state = state[char]
                break
        if self.shorter is not None and self.spare[0]:
            self.spare[0] -= 1
            self[char] = state
        return state


def _trie(ids: dict[str, int]) -> _Node:
    """Root of the trie of the pieces, with the ends that each node shares."""
    spare = [0]
    root = _Node(spare)
    for piece, number in ids.items():
        node = root
        for c in piece:
            if c not in node:
                node[c] = _Node(spare)
            node = node[c]
        node.ends = ((len(piece), number),)
    level = [root]
    while level:
        below = []
        for node in level:
            for c, child in node.items():
                child.shorter = root if node is root else node.shorter[c]
                child.ends += child.shorter.ends
                below.append(child)
        level = below
    spare[0] = _STEPS
    return root


class _Followers(dict):
    """Whether a piece stays apart from the last one, by piece; worked out when first asked for."""

    __slots__ = ("encoder", "last")

    def __init__(self, encoder: Encoder, last: int):
        self.encoder, self.last = encoder, last

    def __missing__(self, piece: int) -> bool:
        ok = self[piece] = self.encoder._stays_apart(self.last, piece)
        self.encoder.pairs += 1
        return ok


class Encoder:
    """Encodes marked words; keeps what it found, within bounds."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: Ids of a word, four bytes each.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.codes = [np.int32(i).tobytes() for i in range(len(vocabulary.pieces))]
        #: Characters of a piece; of the last one, -1, a single one.
        self.sizes = [*map(len, vocabulary.pieces), 1]
        self.root = _trie(vocabulary.ids)
        self.costs = {p: -vocabulary.scores[i] for p, i in vocabulary.ids.items()}
        #: By last piece; -1, the last row, stands for none.
        self.apart = [_Followers(self, i) for i in (*range(len(vocabulary.pieces)), -1)]
        self.pairs = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.pack(texts)]

    def pack(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        cut = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = set(chain.from_iterable(cut))
        if len(self.known) > _CACHE:  # older words that are not met again go
            self.older, self.known = self.known, {w: self.older[w] for w in words if w in self.older}
        self.learn(words)
        known = self.known
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        if self.pairs > _PAIRS:
            for row in self.apart:
                row.clear()
            self.pairs = 0
        return out

    def forget(self) -> None:
        """Let go of the words at the end of a task, as Python workers outlive it; the pairs are few and costly."""
        self.known, self.older = {}, {}

    def learn(self, words: set[str]) -> None:
        """Encode the words that are new: sorted, they are a trie's leaves in depth-first order."""
        known, older = self.known, self.older
        new = []
        for word in words.difference(known):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        new.sort()
        (self._walk_bpe if self.v.bpe else self._walk_unigram)(new)

    def _spell(self, char: str) -> bytes:
        """A character outside the vocabulary."""
        raw = char.encode()
        if all(b in self.v.bytes for b in raw):
            return b"".join(self.codes[self.v.bytes[b]] for b in raw)
        return self.codes[self.v.unknown]

    def _read(self, word: str, last: list[int]) -> bytes:
        codes, sizes, out, at = self.codes, self.sizes, [], len(word)
        while at:
            piece = last[at]
            out.append(codes[piece] if piece >= 0 else self._spell(word[at - 1]))
            at -= sizes[piece]
        out.reverse()
        return b"".join(out)

    def _walk_bpe(self, words: list[str]) -> None:
        """last[j]: the last piece of the encoding of the first j characters.

        states[j] is the node of the pieces' trie reached there; it knows the pieces that end there. Piece
        -1 stands for a character outside the vocabulary, which nothing merges with, and for the word's head.
        """
        apart, known = self.apart, self.known
        size = max(map(len, words), default=0) + 1
        last, states, before = [-1] * size, [self.root] * size, ""
        for word, at in zip(words, _shared_heads(words)):
            if at == _HEAD:
                at += _shared(word[at:], before[at:])
            state = states[at]
            for j, c in enumerate(word[at:], at + 1):
                states[j] = state = state[c]
                for n, piece in state.ends:
                    if apart[last[j - n]][piece]:
                        last[j] = piece
                        break
                else:
                    last[j] = -1
            before = word
            known[word] = self._read(word, last)

    def _stays_apart(self, left: int, right: int) -> bool:
        """The two pieces' joint text is encoded as just these two (``left`` -1: the right one as itself)."""
        pieces = self.v.pieces
        if left < 0:
            return self.merge(pieces[right]) == [right]
        return self.merge(pieces[left] + pieces[right]) == [left, right]

    def merge(self, text: str) -> list[int]:
        """The BPE result for a short text: join the neighbours whose joint piece scores best, leftmost first."""
        ids, costs, never = self.v.ids, self.costs, float("inf")
        parts = list(text)
        joint = [costs.get(a + b, never) for a, b in zip(parts, parts[1:])]
        while joint:
            best = min(joint)
            if best == never:
                break
            at = joint.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at:
                joint[at - 1] = costs.get(parts[at - 1] + parts[at], never)
            if at < len(joint):
                joint[at] = costs.get(parts[at] + parts[at + 1], never)
        return [ids.get(p, -1) for p in parts]

    def _walk_unigram(self, words: list[str]) -> None:
        """Viterbi: best[j] is the best score of a path over the first j characters."""
        scores, known, lowest = self.v.scores, self.known, self.v.lowest
        size = max(map(len, words), default=0) + 1
        best, last, states, before = [0.0] * size, [-1] * size, [self.root] * size, ""
        for word, at in zip(words, _shared_heads(words)):
            if at == _HEAD:
                at += _shared(word[at:], before[at:])
            state = states[at]
            for j, c in enumerate(word[at:], at + 1):
                states[j] = state = state[c]
                top, found, n = None, -1, 0
                for n, piece in state.ends:
                    score = best[j - n] + scores[piece]
                    if top is None or score > top:
                        top, found = score, piece
                if n != 1 and (top is None or best[j - 1] + lowest > top):  # no piece of this character alone
                    top, found = best[j - 1] + lowest, -1
                best[j], last[j] = top, found
            before = word
            known[word] = self._read(word, last)


def _shared_heads(words: list[str]) -> list[int]:
    """Length of each word's common prefix with the word before it, ``_HEAD`` at most."""
    if not words:
        return []
    chars = np.array(words, f"U{_HEAD}").view(np.uint32).reshape(len(words), _HEAD)
    differ = np.ones((len(words), _HEAD + 1), bool)
    np.not_equal(chars[1:], chars[:-1], out=differ[1:, :-1])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    shared = np.minimum(differ.argmax(axis=1), sizes)
    shared[1:] = np.minimum(shared[1:], sizes[:-1])
    return shared.tolist()


def _shared(word: str, before: str) -> int:
    """Length of the common prefix."""
    k = 0
    for a, b in zip(word, before):
        if a != b:
            break
        k += 1
    return k


def decode(ids: Iterable[int], raw: list[bytes]) -> str:
    """The text of some ids; bytes that are not UTF-8 become U+FFFD, one blank in front is the mark that encoding adds."""
    text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = MODEL) -> Encoder:
    """One encoder for each model in a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_chars, round_trip`` for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in small_batches(batches, "text", 1 << 19):
            texts = batch.column("text").to_pylist()
            ids = enc.pack(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), np.int32)
            back = [decode(np.frombuffer(i, np.int32).tolist(), enc.v.raw) for i in ids]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                 pa.array([len(t) for t in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back)])],
                names=["doc_id", "n_tokens", "ids", "decoded_chars", "round_trip"])
        enc.forget()

    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_chars long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids are the empty text, unknown ids raise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoder(path).v.raw
        for batch in batches:
            texts = [decode(i or [], raw) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
