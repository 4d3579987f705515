"""SentencePiece encoding and decoding: exact merge-type (BPE) encoding by
backtracking, without simulating the merges of the whole text.

* An Aho-Corasick pass over a chunk gives the longest piece that starts at
  every position; each piece knows its next shorter prefix piece.
* A piece may follow another if re-merging the two pieces' characters gives
  back just these two (cached per pair).  A row of pieces whose neighbours
  all fit is the merge result of the whole, and the only such row: the first
  merge that crossed a boundary would also cross it in the pair alone.
* The encoder takes the longest piece that fits, else a shorter one, else it
  marks the position as failed in a bitfield and takes the last piece back.
  The merge result of a prefix is unique, so a position fails for good and
  every position is left at most once.

A chunk ends where no piece of the vocabulary can lie across: before a run
of spaces, around characters that no longer piece holds, between words and
ASCII punctuation; a class the vocabulary joins is no border.  Chunks are
encoded once and remembered (a bounded cache per task).  There is no
shuffle; a text takes a task about its own length of ids in memory.

Defined cases: null and empty texts have no ids and decode to ''; a text
always gets the space in front that the model asks for; the space mark
U+2581 in a text is a space; characters that no piece knows become byte
pieces (the unknown id where the model has none); null ids decode to null;
ids out of range raise.  Ties of equal scores merge from the left.  Repeated
rows, extra columns and empty tables pass through.
"""

from __future__ import annotations

import re
import sys
import types
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.common import share, shared

SPACE = "▁"  # fixed value: the model's mark for a space
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
WORD_CACHE = 200_000  # words of up to 48 characters
PAIR_CACHE = 1_000_000


def merge(text: str, scores: dict[str, float], history: list | None = None) -> list[str]:
    """The defining rule: merge the neighbouring parts with the best score,
    the leftmost of equals, until no two parts make a piece.  ``history``
    takes (score, first part, last part) after every merge."""
    parts, none = list(text), float("-inf")
    best = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while best:
        top = max(best)
        if top == none:
            break
        at = best.index(top)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del best[at]
        if at < len(best):
            best[at] = scores.get(parts[at] + parts[at + 1], none)
        if at:
            best[at - 1] = scores.get(parts[at - 1] + parts[at], none)
        if history is not None:
            history.append((top, parts[0], parts[-1]))
    return parts


class Vocabulary:
    """Pieces, scores and byte ids of a model file, with what the encoder
    derives from them; small (one entry per piece), so it is broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: dict[int, int],
                 control: set[int], unknown: int, unknown_surface: str):
        self.pieces, self.byte_ids, self.unknown = pieces, byte_ids, unknown
        self.scores = {p: s for p, s, n in zip(pieces, scores, normal) if n}
        self.ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        # pieces that their own characters don't merge to are never in a result
        self.whole = {p: i for p, i in self.ids.items() if merge(p, self.scores) == [p]}
        self.shorter: dict[int, int] = {}
        for p, i in self.whole.items():
            k = next((k for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), 0)
            self.shorter[i] = self.whole[p[:k]] if k else (-1 if len(p) == 1 else self.single(p[0]))
        of_byte = {i: bytes([b]) for b, i in byte_ids.items()}
        self.surface = [of_byte[i] if i in of_byte else None if i in control else
                        unknown_surface.encode() if i == unknown else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        long = [p for p in self.scores if len(p) > 1]
        joined = {c for p in long for c in p}
        self.spaces_start = not any(SPACE in p.lstrip(SPACE) for p in long)
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in joined and c != " "))
        kinds = "\n".join("".join(map(self._kind, p)) for p in long)
        marks = "" if "lp" in kinds or "pl" in kinds else re.escape(PUNCTUATION)
        gap = rf"[ {SPACE}]"
        self.chunk = (rf"{gap}*{LETTER}+(?=[ {SPACE}{marks}{alone}]|$)|" + (f"[{alone}]|" if alone else "")
                      + rf"{gap}*[^ {SPACE}{alone}]+|{gap}+") if self.spaces_start else "(?s:.+)"

    @staticmethod
    def _kind(c: str) -> str:
        return "s" if c == SPACE else "p" if c in PUNCTUATION else "l" if re.match(LETTER, c) else "o"

    def single(self, c: str) -> int:
        """Token of one character: its piece, else a number above all ids."""
        return self.whole.get(c, len(self.pieces) + ord(c))


def read_model(path: str) -> Vocabulary:
    """Vocabulary of a SentencePiece model file.  Models this operator can't
    encode exactly (not BPE, with a normaliser, user-defined pieces, ...)
    raise ValueError."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    norm, kind = m.normalizer_spec, pb.ModelProto.SentencePiece
    if (m.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or not norm.add_dummy_prefix
            or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix
            or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in m.pieces)):
        raise ValueError("only BPE models with identity normalisation are encoded exactly")
    return Vocabulary([p.piece for p in m.pieces], [p.score for p in m.pieces],
                      [p.type == kind.NORMAL for p in m.pieces],
                      {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE},
                      {i for i, p in enumerate(m.pieces) if p.type == kind.CONTROL},
                      next(i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN), m.trainer_spec.unk_surface)


class Encoder(dict):
    """Ids of whole texts; as a dict it remembers the ids (int32 bytes) of
    words that follow a space."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v, self.known, self.fitting, self.steps = v, {}, {}, {}
        self.top = len(v.pieces)
        self.size = [len(p) for p in v.pieces]
        automaton = ahocorasick.Automaton()
        for p, i in v.whole.items():
            automaton.add_word(p, (i, len(p) - 1))
        automaton.make_automaton()
        self.longest_pieces = automaton.iter_long
        self.split = re.compile(v.chunk).findall
        self.border = re.compile(rf"(?<![ {SPACE}])[ {SPACE}]")
        self.many = ManyWords(self)

    def merges(self, token: int) -> list[tuple]:
        """(score, first part, last part) at the start and after each merge."""
        steps = self.steps.get(token)
        if steps is None:
            text = self.v.pieces[token] if token < self.top else chr(token - self.top)
            steps = self.steps[token] = [(None, text[0], text[-1])]
            merge(text, self.v.scores, steps)
            if token >= self.top and len(self.steps) > 2 * self.top:  # odd characters
                self.steps.clear()
        return steps

    def joins(self, a: int, b: int) -> bool:
        """Whether re-merging the characters of ``a`` and ``b`` gives back just
        these two.  Both sides repeat the merges they make alone, best score
        first, as long as no merge over the border is as good."""
        left, right = self.merges(a), self.merges(b)
        scores, none, i, j = self.v.scores, float("-inf"), 0, 0
        while True:
            over = scores.get(left[i][2] + right[j][1], none)
            on_left = left[i + 1][0] if i + 1 < len(left) else none
            on_right = right[j + 1][0] if j + 1 < len(right) else none
            if over != none and over > on_left and over >= on_right:  # the leftmost of equals goes first
                return False
            if on_left == none and on_right == none:
                return True
            if on_left >= on_right:
                i += 1
            else:
                j += 1

    def fit(self, last: int, token: int) -> int:
        """``token``, or the longest shorter piece of its prefixes, that may
        follow ``last``; -1 if there is none."""
        found = token
        while found >= 0 and last >= 0 and not self.joins(last, found):
            found = self.v.shorter.get(found, -1)
        if len(self.fitting) >= PAIR_CACHE:
            self.fitting.clear()
        self.fitting[last, token] = found
        return found

    def tokens(self, chunk: str) -> list[int]:
        """Pieces of a chunk by backtracking."""
        n, size, top, fitting, shorter = len(chunk), self.size, self.top, self.fitting, self.v.shorter
        longest = {end - k: t for end, (t, k) in self.longest_pieces(chunk)}  # along the greedy path
        failed, any_failed = bytearray(n // 8 + 1), False
        out, last, pos, token = [], -1, 0, None
        while pos < n:
            if token is None:
                token = longest.get(pos)
                if token is None:  # off the greedy path
                    end, (token, k) = next(self.longest_pieces(chunk, pos), (n, (0, 0)))
                    if end - k != pos:
                        token = top + ord(chunk[pos])
                    longest[pos] = token
            found = fitting.get((last, token))
            if found is None:
                found = self.fit(last, token)
            end = pos + (size[found] if found < top else 1)
            while any_failed and found >= 0 and failed[end >> 3] >> (end & 7) & 1:
                found = self.fit(last, shorter.get(found, -1))
                end = pos + (size[found] if found < top else 1)
            if found >= 0:
                out.append(found)
                last, pos, token = found, end, None
            else:  # no piece leads on from here: take the last one back and shorten it
                failed[pos >> 3] |= 1 << (pos & 7)
                any_failed = True
                token = out.pop()
                pos -= size[token] if token < top else 1
                last, token = out[-1] if out else -1, shorter.get(token, -1)
        return out

    def __missing__(self, word: str) -> bytes:
        parts = self.split(" " + word)
        found = self.spell(parts[0]) if len(parts) == 1 else b"".join(map(self.of_chunk, parts))
        if len(word) <= 48 and len(self) < WORD_CACHE:
            self[word] = found
        return found

    def of_chunk(self, chunk: str) -> bytes:
        if chunk[0] == " ":
            return self[chunk[1:]]
        found = self.known.get(chunk)
        if found is None:
            found = self.spell(chunk)
            if len(chunk) <= 48:
                if len(self.known) >= WORD_CACHE // 4:
                    self.known.clear()
                self.known[chunk] = found
        return found

    def spell(self, chunk: str) -> bytes:
        ids = array("i", self.tokens(chunk.replace(" ", SPACE)))
        if max(ids) >= self.top:  # characters without a piece
            byte_ids, unknown = self.v.byte_ids, [self.v.unknown]
            ids = array("i", [i for t in ids for i in (
                [t] if t < self.top else unknown if not byte_ids else
                [byte_ids[b] for b in chr(t - self.top).encode("utf-8", "surrogatepass")])])
        return ids.tobytes()

    def encode(self, text: str | None, block: int = 1 << 20) -> np.ndarray:
        """Ids of a whole text, a block that ends before a run of spaces at a time."""
        if not text:
            return np.zeros(0, np.int32)
        text, found, start = " " + text, [], 0
        while start < len(text):
            m = self.border.search(text, start + block) if self.v.spaces_start else None
            end = m.start() if m else len(text)
            words = self.words(text[start:end])
            found.append(b"".join(map(self.__getitem__, words)) if words is not None else
                         b"".join(map(self.of_chunk, self.split(text[start:end]))))
            start = end
        return np.frombuffer(b"".join(found), np.int32)

    def words(self, part: str) -> list[str] | None:
        """Words between single spaces; None where a part isn't made of those."""
        if self.v.spaces_start and part[0] == " " and part[-1] != " " and "  " not in part and SPACE not in part:
            return part[1:].split(" ")
        return None

    def encode_all(self, texts, group: int = 1 << 22) -> list[np.ndarray]:
        """Ids of many texts; the new words of a few million characters are
        learnt together."""
        out, at = [], 0
        while at < len(texts):
            held, chars, fresh = [], 0, set()
            if len(self) >= WORD_CACHE:
                self.clear()
            while at < len(texts) and chars < group:
                text = texts[at] or ""
                words = self.words(" " + text) if 0 < len(text) < group else None
                fresh.update(words or ())
                held.append((text, words))
                chars += len(text)
                at += 1
            self.many.learn(fresh.difference(self))
            out.extend(self.encode(text) if words is None else
                       np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32) for text, words in held)
        return out


class ManyWords:
    """The same backtracking for many short words at a time: the automaton's
    transitions, the pairs that fit and the words' states are arrays.  Words
    with characters outside ASCII and the commonest others are left out."""

    LONGEST = 48

    def __init__(self, encoder: Encoder):
        self.encoder, v = encoder, encoder.v
        often = Counter(c for p in v.whole if len(p) > 1 for c in p if c in v.whole)
        ascii_ = [chr(i) for i in range(1, 128) if chr(i) != " "]
        rest = sorted((c for c in often if ord(c) > 127), key=lambda c: (-often[c], c))
        column = {c: k + 1 for k, c in enumerate([*ascii_, *rest][:255])}
        self.column = np.zeros(max(map(ord, column)) + 2, np.uint8)
        for c, k in column.items():
            self.column[ord(c)] = k
        nodes, edges, piece = {"": 0}, [], [-1]
        for p in sorted({*v.whole, *ascii_}):
            if all(c in column for c in p):
                for k in range(1, len(p) + 1):
                    if p[:k] not in nodes:
                        nodes[p[:k]] = len(nodes)
                        piece.append(v.single(p) if k == len(p) == 1 else v.whole.get(p[:k], -1))
                        edges.append((nodes[p[:k - 1]], column[p[k - 1]], nodes[p[:k]]))
        self.next = np.zeros((len(nodes), 256), np.uint16 if len(nodes) < 1 << 16 else np.int32)
        parent, col, child = np.array(edges, np.int64).reshape(-1, 3).T
        self.next[parent, col] = child
        self.piece = np.array(piece, np.int32)
        # after the pieces the ASCII characters without one; the last entry serves token -1
        self.size = np.array([*encoder.size, *[1] * 128, 0], np.int64)
        self.shorter = np.array([v.shorter.get(i, -1) for i in range(encoder.top)] + [-1] * 129, np.int64)
        self.ids = np.array([*range(encoder.top), *[v.byte_ids.get(b, v.unknown) for b in range(128)]], np.int32)
        self.base = encoder.top + 128
        self.keys, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def longest(self, c: np.ndarray) -> np.ndarray:
        """Longest piece that starts at every position; column 0 ends a word."""
        node = self.next[0, c].astype(np.int32)
        found, at, depth = self.piece[node], np.flatnonzero(node), 1
        node = node[at]
        while len(at):
            node = self.next[node, c[at + depth]]
            on = node > 0
            at, node, depth = at[on], node[on], depth + 1
            piece = self.piece[node]
            found[at] = np.where(piece >= 0, piece, found[at])
        return found

    def fits(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``Encoder.fit`` of many pairs."""
        out = token.copy()
        ask = np.flatnonzero((last >= 0) & (token >= 0))
        key = last[ask] * self.base + token[ask]
        at = np.searchsorted(self.keys, key)
        new = np.unique(key[(np.append(self.keys, -1)[at] != key)])
        if len(new):
            if len(self.keys) > PAIR_CACHE:
                self.keys, self.values = self.keys[:0], self.values[:0]
                new = np.unique(key)
            values = [self.encoder.fit(*divmod(k, self.base)) for k in new.tolist()]
            self.encoder.fitting.clear()
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], np.concatenate([self.values, np.array(values, np.int64)])[order]
            at = np.searchsorted(self.keys, key)
        out[ask] = self.values[at]
        return out

    def learn(self, words) -> None:
        """Puts the ids of the words into the encoder."""
        words = [w for w in words if 0 < len(w) <= self.LONGEST]
        if not words:
            return
        joined = SPACE + ("\0" + SPACE).join(words) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.column[np.minimum(code, len(self.column) - 1)]
        c[code == 0] = 0
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.cumsum(length + 1) - length - 1
        zeros = np.concatenate([[0], np.cumsum(c == 0)])
        plain = np.flatnonzero(zeros[start + length] == zeros[start])  # no foreign character, no NUL of its own
        if not len(plain):
            return
        longest = self.longest(c).astype(np.int64)
        pos, end = start[plain].copy(), (start + length)[plain]
        n = len(plain)
        last, token, depth = np.full(n, -1), np.full(n, -2), np.zeros(n, np.int64)
        out = np.zeros((n, int(length.max())), np.int32)
        failed = np.zeros(len(c) + 1, bool)
        live = np.arange(n)
        while len(live):
            p, before = pos[live], last[live]
            found = self.fits(before, np.where(token[live] == -2, longest[p], token[live]))
            while True:
                bad = np.flatnonzero((found >= 0) & failed[p + self.size[found]])
                if not len(bad):
                    break
                found[bad] = self.fits(before[bad], self.shorter[found[bad]])
            on = found >= 0
            go, to = live[on], found[on]
            out[go, depth[go]] = to
            depth[go] += 1
            last[go], token[go] = to, -2
            pos[go] += self.size[to]
            back = live[~on]
            if len(back):
                failed[p[~on]] = True
                depth[back] -= 1
                gone = out[back, depth[back]]
                pos[back] -= self.size[gone]
                last[back] = np.where(depth[back] > 0, out[back, depth[back] - 1], -1)
                token[back] = self.shorter[gone]
            live = live[pos[live] < end[live]]
        flat = self.ids[out[np.arange(out.shape[1]) < depth[:, None]]].tobytes()
        stop = (4 * np.cumsum(depth)).tolist()
        self.encoder.update(zip(map(words.__getitem__, plain.tolist()),
                                [flat[a:b] for a, b in zip([0, *stop], stop)]))


def decode_ids(ids, v: Vocabulary) -> str:
    """Text of ids: the pieces' surfaces, without the space that encoding put
    in front; a byte piece that is no part of a whole character is U+FFFD."""
    surface = v.surface
    try:
        text = b"".join(map(surface.__getitem__, ids)).decode("utf-8")
    except (UnicodeDecodeError, TypeError):  # broken characters, control ids
        text = _decode_broken(ids, v)
    first = next((i for i in ids if surface[i]), None)
    return text[1:] if first is not None and v.pieces[first].startswith(SPACE) else text


def _decode_broken(ids, v: Vocabulary) -> str:
    lone, out, run = set(v.byte_ids.values()), [], b""
    for i in [*ids, None]:
        if i in lone:
            run += v.surface[i]
            continue
        while run:
            for k in (1, 2, 3, 4):
                try:
                    out.append(run[:k].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k = 1
            run = run[k:]
        if i is not None:
            out.append((v.surface[i] or b"").decode("utf-8"))
    return "".join(out)


def _encoder(vocabulary, key: str) -> Encoder:
    """The encoder of this worker process: workers are reused, so the words and
    pairs of earlier tasks stay known (one encoder, its caches bounded)."""
    store = sys.modules.setdefault("_piece_encoder", types.ModuleType("_piece_encoder"))
    if getattr(store, "key", None) != key:
        store.encoder, store.key = Encoder(shared(vocabulary)), key
    return store.encoder


def _slices(texts: list, chars: int = 1 << 21) -> Iterator[list]:
    """A batch in slices of a few million characters, so that a slice's ids and
    not the batch's are held; output batches need not match input batches."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and n < chars:
            n += len(texts[end] or "")
            end += 1
        yield texts[at:end]
        at = end


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", out_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """Every row of ``docs`` with the ids of its whole text in ``out_col``, and
    with the text that ``decode`` makes of them in ``decoded_col`` if named (in
    the same pass)."""
    vocabulary, key = share(docs.sparkSession, read_model(model_path)), uuid.uuid4().hex

    @F.pandas_udf("ids array<int>, decoded string")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, key)
        for texts in batches:
            for part in _slices(texts.tolist()):
                ids = encoder.encode_all(part)
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(
                    [decode_ids(x.tolist(), encoder.v) for x in ids] if decoded_col else None, dtype=object, index=range(len(ids)))})

    out = docs.withColumn("__ids", ids_of(F.col(text_col))).withColumn(out_col, F.col("__ids.ids"))
    return (out.withColumn(decoded_col, F.col("__ids.decoded")) if decoded_col else out).drop("__ids")


def decode(rows: DataFrame, model_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every row with the text of its ids in ``out_col``."""
    vocabulary = share(rows.sparkSession, read_model(model_path))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = shared(vocabulary)
        for lists in batches:
            yield pd.Series([None if x is None else decode_ids(x.tolist(), v) for x in lists], dtype=object)

    return rows.withColumn(out_col, text_of(F.col(ids_col)))
