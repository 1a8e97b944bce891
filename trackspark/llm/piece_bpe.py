"""SentencePiece BPE encoding by a table of last tokens, and decoding.

Merging pairs by score gives each prefix of a text exactly one encoding, and so one last token. A sequence of tokens is
an encoding if and only if each token is that of its own text and no two neighbours would have merged across their
border. So the last token of a prefix is the one that an automaton finds ending there and that is compatible with the last
token of what is before it. The table is filled from left to right in time linear in the text; ids are read off backwards.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import by_size, uncollected

SPACE = "▁"
#: Types of pieces and of models in the file's format.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
#: Pairs, and words, whose answers each Python worker keeps; when full, the store starts anew.
MEMO = 1_000_000
#: Longer words are not kept.
MEMO_LEN = 64
#: The token of a character that no piece has: bytes stand for it, and nothing merges with it.
FOREIGN = -1
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


def _value(piece: str) -> int:
    """Of a byte's piece, <0x0A> for instance."""
    return int(piece[3:5], 16)


class Pieces:
    """A model: pieces, the merges they stand for, and the automaton over those that are their own encoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = train.model_type == BPE and train.byte_fallback and not train.treat_whitespace_as_suffix and norm.escape_whitespaces and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        if not plain or norm.precompiled_charsmap or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, a leading blank, texts as they are and no symbols of the user's are known here")
        self.begin, self.end, self.unknown = train.bos_id, train.eos_id, train.unk_id
        self.texts = [p.piece for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        order = sorted({-p.score for p in model.pieces})
        place = {score: n for n, score in enumerate(order)}
        #: When a token comes to be: characters first, then by score. Equal scores merge from the left.
        self.rank = [place[-p.score] if len(p.piece) > 1 else -1 for p in model.pieces]
        self.byte = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[_value(p.piece)] = i
        known = dict(normal)
        for char in {c for text in normal for c in text} - known.keys():  # characters that only longer pieces have
            known[char] = len(self.texts)
            self.texts.append(char)
            self.rank.append(-1)
        self.known = known
        #: What two neighbours merge to.
        self.join: dict[tuple[int, int], int] = {}
        for text, i in normal.items():
            for k in range(1, len(text)):
                left, right = known.get(text[:k]), known.get(text[k:])
                if left is not None and right is not None:
                    self.join[left, right] = i
        #: Parts that a token's last merge joined. Steady: each merge of the token comes after those of its parts.
        self.parts: dict[int, tuple[int, int]] = {}
        self.steady: set[int] = set()
        self.automaton = ahocorasick.Automaton()
        for text, i in sorted(known.items(), key=lambda x: len(x[0])):
            if len(text) > 1:
                tokens = [known[c] for c in text]
                while len(tokens) > 2 and self._merge(tokens):
                    pass
                if len(tokens) != 2 or self.join.get((tokens[0], tokens[1])) != i:
                    continue  # merging its text doesn't give it, so no text gives it
                self.parts[i] = tokens[0], tokens[1]
            if all(part in self.steady and self.rank[i] > self.rank[part] for part in self.parts.get(i, ())):
                self.steady.add(i)
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        alphabet = "".join(re.escape(text) for text in known if len(text) == 1)
        self.foreign = re.compile(f"([^{alphabet}])")
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self._decoding(model)

    def _merge(self, tokens: list[int]) -> bool:
        """Merges the leftmost pair of the best score, in place."""
        best = None
        for k in range(len(tokens) - 1):
            token = self.join.get((tokens[k], tokens[k + 1]))
            if token is not None and (best is None or self.rank[token] < best[0]):
                best = self.rank[token], k, token
        if best is not None:
            tokens[best[1] : best[1] + 2] = [best[2]]
        return best is not None

    def compatible(self, left: int, right: int) -> bool:
        """Whether nothing merges across the border of two tokens that stand side by side.

        Going back in time, the token that came to be last falls into its parts, of which one stands at the border. The
        two that then meet there would have merged, if they merge at all, before the fallen token was made.
        """
        if not (left in self.steady and right in self.steady):
            tokens = [self.known[c] for c in self.texts[left] + self.texts[right]]
            while self._merge(tokens):
                pass
            return tokens == [left, right]
        rank, before = self.rank, float("inf")
        while True:
            token = self.join.get((left, right))
            if token is not None and rank[token] < before:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                before = rank[left]
                left = self.parts[left][1]
            else:  # of two equal merges the left one comes first, so the border's goes before the right one
                before = rank[right] + 1
                right = self.parts[right][0]

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix the last token of its encoding, FOREIGN where that is a character of no piece."""
        last, fits = [FOREIGN] * (len(text) + 1), self.fits
        for end, (size, token) in self.automaton.iter(text):
            if last[end + 1] != FOREIGN:
                continue
            before = last[end + 1 - size]
            if before != FOREIGN:
                pair = before << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self.compatible(before, token)
                if not fit:
                    continue
            last[end + 1] = token
        return last

    def tokens(self, text: str) -> bytes:
        """Ids of a text without the model's own blank before it, as little-endian 32-bit integers."""
        last, out, at = self.last_tokens(text), [], len(text)
        while at:
            token = last[at]
            if token == FOREIGN or token >= self.pieces:
                at -= 1
                out.extend(self.byte[b] for b in reversed(text[at].encode()))
            else:
                at -= len(self.texts[token])
                out.append(token)
        return np.array(out[::-1], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a blank and a word; between characters of no piece parts are encoded apart."""
        head, *rest = self.foreign.split(word)
        if not rest:
            return self.tokens(SPACE + word)
        out = [self.tokens(SPACE + head)]
        for part in rest:
            ids = self.inner.get(part)
            if ids is None:
                ids = self.tokens(part)
                if len(part) <= MEMO_LEN:
                    self.inner[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers, without begin and end.

        Blanks become SPACE and one is put before the text. No piece has a SPACE behind another character, so nothing
        merges across the place before one, and words are encoded one by one.
        """
        if not text:
            return b""
        for memo in (self.words, self.inner, self.fits):
            if len(memo) > MEMO:
                memo.clear()
        text = text.replace(SPACE, " ")
        if self.apart and "  " not in text and text[0] != " ":
            words = text.split(" ")
        elif self.apart:
            words = [run[1:] for run in _RUNS.findall(SPACE + text.replace(" ", SPACE))]
        else:
            words = [text.replace(" ", SPACE)]
        memo, out = self.words, []
        for word in words:
            ids = memo.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= MEMO_LEN:
                    memo[word] = ids
            out.append(ids)
        return b"".join(out)

    def _decoding(self, model) -> None:
        self.pieces = len(model.pieces)
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces if p.type == NORMAL)
        raw = []
        for i, p in enumerate(model.pieces):
            plain = model.trainer_spec.unk_surface if p.type == UNKNOWN else p.piece.replace(SPACE, " ")
            raw.append(b"" if p.type == CONTROL else bytes([_value(p.piece)]) if p.type == BYTE else plain.encode())
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.control = np.array([p.type == CONTROL for p in model.pieces])
        self.blank = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids: pieces end to end, SPACE as a blank, the first one's left out; bytes of no character as U+FFFD each.

        Control ids give nothing, but no character goes on across one.
        """
        token = np.frombuffer(ids, "<u4")
        control = self.control[token]
        run, token = np.cumsum(control)[~control], token[~control]
        if not len(token):
            return b""
        size = self.size[token]
        end = np.cumsum(size)
        raw = self.flat[np.arange(end[-1]) + np.repeat(self.first[token] - end + size, size)].tobytes()
        drop = int(self.blank[token[0]])
        if run[0] != run[-1] or not _sound(raw):
            own = np.repeat(self.is_byte[token] * (run + 1), size)
            raw = b"".join(_mended(raw[a:b]) if own[a] else raw[a:b] for a, b in _stretches(own))
        return raw[drop:]


def _sound(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _stretches(marks: np.ndarray):
    """(begin, end) of stretches of equal marks."""
    cut = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)]
    return zip(cut[:-1], cut[1:], strict=True)


def _mended(raw: bytes) -> bytes:
    """Bytes with each that belongs to no character as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            if _sound(raw[at : at + size]):
                out.append(raw[at : at + size])
                at += size
                break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, text: str = "text", begin: bool = True, end: bool = True, keep_ids: bool = True) -> DataFrame:
    """All columns of docs, with n_tokens, ids_sha256, decoded_sha256, round_trip and, if asked for, ids.

    ids are little-endian unsigned 32-bit integers, with the model's begin and end ids if asked for. A null or empty text
    has no others. round_trip tells whether the decoded text is the text: SPACE itself comes back as a blank. Every row
    is encoded by itself, repeated ones too; no rows give no rows. Own columns with those names are replaced. The model
    is opened on each executor, where path must exist.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids"]
    docs = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", "round_trip boolean", *["ids binary"] * keep_ids])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()][: 4 + keep_ids]

    def run(batches):
        model = pieces(path)
        head = np.array([model.begin] * begin, "<u4").tobytes()
        tail = np.array([model.end] * end, "<u4").tobytes()
        with uncollected():
            for batch in by_size(batches, text):
                rows = []
                for one in batch.column(text).to_pylist():
                    ids = head + model.encode(one or "") + tail
                    back = model.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == (one or "").encode(), ids))
                new = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names[: len(new)]])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tables import table

    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
