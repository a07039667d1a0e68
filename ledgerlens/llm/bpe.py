"""BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a batch form a trie (kept as their sorted order: each
word shares with its predecessor the path to their common prefix). A
depth-first walk gives every trie node its *last-token state*: the last token
of the BPE encoding of the node's prefix. That token is the only suffix token
``t`` for which the state of the node before it, ``p``, and ``t`` are
compatible (BPE over the two tokens' symbols gives back ``p, t``), so a node
needs its ancestors' states only, and a prefix shared by many words is encoded
once. A word's ids are read off by stepping back through the states.

Texts are encoded as the vocabulary file says: special tokens are cut out of
the raw text, the rest is NFC-normalised and lower-cased, split into words,
and mapped to byte symbols; the last symbol of a word carries ``</w>``.
Decoding joins the token strings with one space (the file names no decoder).

Rows: null text is empty and gives no ids; every other row and every other
column passes through as it is (repeated rows too). Columns called
``n_tokens``, ``token_ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .text import add_columns, read_table

WORD_END = "</w>"
# Entries a worker keeps of each kind between batches; beyond it a cache starts anew, words in two generations
# so that those met again stay (results do not depend on it).
CACHED = 200_000
# Suffixes of this many symbols are looked up at once.
SUFFIX = 5
# White space, and the short endings that the vocabulary file splits off after an apostrophe.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BASIC = 0x10000
BEYOND = re.compile("[\U00010000-\U0010ffff]")
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: Latin-1 printables
    stand for themselves, the other bytes for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _ranges(kind: str, stop: int = 0x110000) -> str:
    """A regular-expression class body with all characters below ``stop`` of a Unicode category group."""
    out, start = [], None
    for c in range(stop + 1):
        is_in = c < stop and unicodedata.category(chr(c))[0] == kind
        if is_in and start is None:
            start = c
        elif not is_in and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class TrieCoder:
    """Encodes and decodes with one vocabulary; one instance per Python worker."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.symbols = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        self.pair = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = {vocab[a + b]: (vocab[a], vocab[b], rank) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.spines: dict[tuple[int, int], list] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        inner = {s: i for s, i in vocab.items() if not s.endswith(WORD_END)}
        final = {s[:-len(WORD_END)]: i for s, i in vocab.items() if s.endswith(WORD_END)}
        # A token that BPE over its own symbols does not give back can never be a last token.
        whole: dict[int, bool] = {}
        for t in sorted(self.strings, key=lambda i: self.made[i][2] if i in self.made else -1):
            left, right, rank = self.made.get(t, (t, t, -1))
            # A token that no merge makes is there from the start only if it is one symbol.
            whole[t] = len(self.strings[t].removesuffix(WORD_END)) == 1 if rank < 0 else (
                whole[left] and whole[right] and self._stand(left, right, rank))
        self.inner = {s: i for s, i in inner.items() if whole[i]}
        self.final = {s: i for s, i in final.items() if whole[i]}
        # For each tail, how long the tokens that end with it are (those longer than a tail only).
        self.long: dict[bool, dict[str, list]] = {}
        for ends, tokens in ((False, self.inner), (True, self.final)):
            tails: dict[str, set] = {}
            for text in tokens:
                if len(text) > SUFFIX:
                    tails.setdefault(text[-SUFFIX:], set()).add(len(text))
            self.long[ends] = {tail: sorted(ns, reverse=True) for tail, ns in tails.items()}
        self.suffixes: dict[bool, dict[str, tuple]] = {False: {}, True: {}}
        self.find_ascii = self._finder("a-z", "0-9")
        # Without characters beyond the basic plane a class is one bitmap, with them a list of ranges to go through.
        self.find_basic = self._finder(_ranges("L", BASIC), _ranges("N", BASIC))
        self.find = self._finder(_ranges("L"), _ranges("N"))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.packed = {t: t.to_bytes(4, "little") for t in self.strings}
        self.table = pa.array([self.strings.get(i) for i in range(max(self.strings) + 1)], pa.string())
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _finder(letters: str, numbers: str):
        return re.compile(f"[{letters}]+|'(?:{'|'.join(ENDINGS)})|[{numbers}]|[^{SPACE}{letters}{numbers}]+").findall

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """From the outermost symbol of a token (side 0: its first, 1: its last) up to
        the token: (token, rank of the merge that takes it into the next)."""
        got = self.spines.get((token, side))
        if got is None:
            way, until = [], float("inf")
            while True:
                way.append((token, until))
                if token not in self.made:
                    break
                until = self.made[token][2]
                token = self.made[token][side]
            way.reverse()
            got = self.spines[(way[-1][0], side)] = way
        return got

    def _stand(self, p: int, t: int, allowed: int = -1) -> bool:
        """Whether BPE over the symbols of ``p`` and ``t`` leaves their border
        alone. Merges happen by rank, leftmost first; the two spines say which
        two symbols meet at the border at each time. A merge across it of rank
        ``allowed`` may come last."""
        left, right = self._spine(p, 1), self._spine(t, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.pair.get((x, y))
            if across is not None and across < x_until and across <= y_until:
                return across == allowed and i == len(left) - 1 and j == len(right) - 1
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _fit(self, p: int, t: int) -> bool:
        if len(self.fits) > CACHED:
            self.fits.clear()
        got = self.fits[p << 20 | t] = self._stand(p, t)
        return got

    def _endings(self, tail: str, ends: bool) -> tuple:
        """How a prefix with this tail can end: the lengths of longer tokens to look
        up, then (length, token) for the tokens inside the tail; longest first."""
        tokens, known = (self.final if ends else self.inner), self.suffixes[ends]
        if len(known) > CACHED // 4:
            known.clear()
        within = tuple((n, tokens[tail[-n:]]) for n in range(len(tail), 0, -1) if tail[-n:] in tokens)
        got = known[tail] = (self.long[ends].get(tail, ()), within)
        return got

    def _last(self, symbols: str, depth: int, state: list, ends: bool) -> tuple[int, int]:
        """(last token, depth before it) of the prefix of this depth."""
        tail = symbols[depth - SUFFIX if depth > SUFFIX else 0:depth]
        longer, within = self.suffixes[ends].get(tail) or self._endings(tail, ends)
        fits = self.fits
        if longer:
            tokens = self.final if ends else self.inner
            for n in longer:
                if n <= depth:
                    t = tokens.get(symbols[depth - n:depth])
                    if t is not None:
                        if n == depth:
                            return t, 0
                        p = state[depth - n][0]
                        ok = fits.get(p << 20 | t)
                        if ok or (ok is None and self._fit(p, t)):
                            return t, depth - n
        for n, t in within:
            if n == depth:
                return t, 0
            p = state[depth - n][0]
            ok = fits.get(p << 20 | t)
            if ok or (ok is None and self._fit(p, t)):
                return t, depth - n
        raise ValueError("the vocabulary has no symbol for a byte")

    def learn(self, words: set[str]) -> None:
        """Depth-first walk over the trie of the words that are not known yet."""
        if len(self.words) > CACHED:
            self.older, self.words = self.words, {}
        known, older, unknown = self.words, self.older, []
        for w in words:
            if w not in known:
                ids = older.get(w)
                if ids is None:
                    unknown.append(w)
                else:
                    known[w] = ids
        # Printable ASCII stands for itself.
        new = sorted([(w if w.isascii() and w.isprintable() else
                       w.encode("utf-8", "replace").decode("latin-1").translate(self.symbols), w) for w in unknown])
        state: list = [None]
        before, last, packed = "", self._last, self.packed
        for symbols, word in new:
            size = len(symbols)
            shared, most = 0, min(len(before), size - 1, len(state) - 1)
            while shared < most and before[shared] == symbols[shared]:
                shared += 1
            del state[shared + 1:]
            for depth in range(shared + 1, size):
                state.append(last(symbols, depth, state, False))
            t, at = last(symbols, size, state, True)
            ids = packed[t]
            while at:
                t, at = state[at]
                ids = packed[t] + ids
            known[word] = ids
            before = symbols

    def _words(self, text: str) -> list[str]:
        """The words of a text without special tokens; none holds white space."""
        if text.isascii():
            return self.find_ascii(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")   # lower-cased by itself, wherever it stands
        return (self.find if BEYOND.search(text) else self.find_basic)(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        cut = [[text] if "<|" not in text else self.cut.split(text) for text in texts]
        split = [[self.packed[self.special[p]] if i % 2 else self._words(p) for i, p in enumerate(ps)] for ps in cut]
        words: set[str] = set()
        for ps in split:
            for p in ps[::2]:
                words.update(p)
        self.learn(words)
        word = self.words.__getitem__
        return [b"".join(p if i % 2 else b"".join(map(word, p)) for i, p in enumerate(ps)) for ps in split]

    def decode(self, packed: bytes) -> str:
        return self.decode_all([packed])[0].as_py()

    def decode_all(self, packed: list[bytes]) -> pa.Array:
        """The texts of packed ids."""
        found = self.table.take(pa.array(np.frombuffer(b"".join(packed), "<u4")))
        if found.null_count:
            raise KeyError("an id that the vocabulary does not have")
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ")


_CODER: list[tuple[str, TrieCoder]] = []


def _coder(spec) -> TrieCoder:
    """The worker's coder for a broadcast vocabulary, kept with the vocabulary that it was made from."""
    if not _CODER or (_CODER[0][0] is not spec.value and _CODER[0][0] != spec.value):
        _CODER[:] = [(spec.value, TrieCoder(spec.value))]
    return _CODER[0][1]


def _broadcast(spark: SparkSession, path: str | None):
    """The vocabulary file (a public file of 1.7 MB; its size is fixed by its publisher)."""
    ship_package(spark)
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(column: pa.Array, most: int = 1 << 22):
    """Lists of texts of about ``most`` characters together."""
    part, size = [], 0
    for x in column:
        x = x.as_py() or ""
        part.append(x)
        size += len(x)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def encode(df: DataFrame, text: str = "text", vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """``df`` with ``n_tokens`` and ``token_ids`` (packed little-endian uint32);
    with ``decoded``, also the text that the ids decode to, made in the same pass."""
    spec = _broadcast(df.sparkSession, vocabulary)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))

    def build(batch):
        coder = _coder(spec)
        ids, back = [], []
        for texts in _texts(batch.column(batch.schema.get_field_index(text))):
            packed = coder.encode(texts)
            ids += packed
            if decoded:
                back.append(coder.decode_all(packed))
        made = [pa.array([len(p) // 4 for p in ids], pa.int64()), pa.array(ids, pa.binary())]
        return made + ([_joined(back)] if decoded else [])

    return add_columns(df, fields, build)


def decode(df: DataFrame, ids: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``decoded``: the text of packed ids (null: empty)."""
    spec = _broadcast(df.sparkSession, vocabulary)

    def build(batch):
        coder = _coder(spec)
        packed = [p or b"" for p in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
        return [_joined([coder.decode_all(packed)])]

    return add_columns(df, [T.StructField("decoded", T.StringType())], build)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded; digests of the ids and of the decoded text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
