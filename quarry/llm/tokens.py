"""Token counts of whole texts under a BPE vocabulary with word ends (a ``tokenizers`` JSON file).

The whole-token shortcut: offline, once per vocabulary, every entry that ends a word is merged from its single symbols;
entries whose merges end in exactly one token form the proven set. A pre-token in that set counts 1 without merging; only
the rest is merged, and the result of each distinct piece of text is remembered by the worker within a bound.

A pre-token never holds white space and no rule looks across it, so a text's count is the sum over its pieces between
white space; pieces repeat, so most of a text is dictionary look-ups. Normalisation is that of the vocabulary file: NFC,
white space runs, then lower case character by character. Strings of special tokens inside a text count one token each,
as the library's default has it.

Nulls and odd cases: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are counted
each; extra columns are ignored; an empty table gives an empty result. Very long texts are handled piece by piece.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches

END = "</w>"
#: The pre-token pattern and the special strings of the vocabulary file (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Letters and numbers of Unicode versions newer than the library's, which are neither for it (fixed values).
NEWER = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a"
    "\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2"
    "\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
STRICT = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{NEWER}]]+|[\p{{N}}--[{NEWER}]]|(?:[^{SPACE}\p{{L}}\p{{N}}]|[{NEWER}])+"
#: Capitals that the library knows and Python's tables don't (fixed values): single ones, then two scripts.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Distinct pieces that a worker remembers; beyond it, the memory starts anew.
REMEMBERED = 1_000_000
#: Symbols of a pre-token from which merging goes by a heap.
LONG = 40

_worker: dict[str, Counter] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one above 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(free))
        free += b not in own
    return out


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merging: the pair of lowest rank is merged, leftmost first, until none is left."""
    if len(symbols) > LONG:
        return _merged_long(symbols, ranks)
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            rank = ranks.get((symbols[i], symbols[i + 1]))
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def _merged_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same in n log n steps: a heap of (rank, place) over a linked list."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    text: list[str | None] = list(symbols)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if text[i] != a or j < 0 or text[j] != b:  # one side has merged since
            continue
        text[i], text[j] = a + b, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (r := ranks.get((text[x], text[y]))) is not None:
                heapq.heappush(heap, (r, x, text[x], text[y]))
    return [t for t in text if t is not None]


def proven_single(vocab: dict[str, int], merges: list[tuple[str, str]]) -> set[str]:
    """Vocabulary strings with a word end that, as a pre-token of their own, are one token; without the end mark."""
    ranks = {m: i for i, m in enumerate(merges)}
    out = set()
    for entry in vocab:
        if entry.endswith(END) and len(entry) > len(END):
            text = entry[: -len(END)]
            if merged([*text[:-1], text[-1] + END], ranks) == [entry]:
                out.add(text)
    return out


class Counter(dict):
    """piece of text without white space -> number of its tokens, filled on demand."""

    def __init__(self, vocabulary: str, single: set[str]) -> None:
        super().__init__()
        model = json.loads(vocabulary)
        self.ranks = {(m[0], m[1]): i for i, m in enumerate(tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in model["model"]["merges"])}
        self.known = model["model"]["vocab"]
        self.single = single
        self.special = [x["content"] for x in model["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find, self.find_strict = regex.compile(PRETOKEN).findall, regex.compile(STRICT).findall
        self.newer, self.capital = regex.compile(f"[{NEWER}]").search, regex.compile("[" + "".join(map(chr, LOWER)) + "]").search
        self.symbols = byte_symbols()

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = 0
        for token in (self.find if piece.isascii() or not self.newer(piece) else self.find_strict)(piece):
            text = token if token.isascii() and token.isprintable() else "".join(map(self.symbols.__getitem__, token.encode()))
            if text in self.single:
                n += 1
            else:
                parts = merged([*text[:-1], text[-1] + END], self.ranks)
                n += sum(p in self.known for p in parts)
        if len(piece) < 200:
            self[piece] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text that holds no special string."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # str.lower() looks at a final sigma's place in the word; the vocabulary's rule goes character by character
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            if self.capital(text):
                text = text.translate(LOWER)
        else:
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for split(), but not for the pattern
            return sum(map(self.__getitem__, regex.split(f"[{SPACE}]+", text)))
        return sum(map(self.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split is None or "<|" not in text:
            return self.plain(text)
        return sum(1 if part in self.special else self.plain(part) for part in self.split.split(text) if part)


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (more than limit tokens) for every row of docs."""
    small_batches(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    model = json.loads(vocabulary)["model"]
    single = proven_single(model["vocab"], [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in model["merges"]])
    # bounded by the vocabulary file, whatever the size of the corpus
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, single))
    key = f"{vocabulary_path}:{len(vocabulary)}:{hash(vocabulary)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker.get(key) or _worker.setdefault(key, Counter(*sent.value))
        for batch in batches:
            texts = batch.column("text")
            n = [counter.count(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "n_bytes"]).columns, pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
