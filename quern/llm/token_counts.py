"""Token counts by overlap resynchronisation.

A text longer than ``chunk_chars`` is cut into overlapping chunks. Each chunk is
encoded by the tokenizer's library with offsets, and two neighbours are spliced
at a boundary where both encodings start a token and which the tokenizer's own
configuration proves stable: nothing left of it can change a token right of it,
nor the reverse. Where the overlap holds no such boundary (a run of thousands of
characters without white space) the overlap is doubled, in the end to both
chunks together, so the count is that of the whole text whatever it holds.

A text of one chunk needs no splice. Its encoding is put together from the
library's encodings of the segments between stable boundaries, which are
remembered, since the same words come again and again.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_texts

#: Bytes of segments whose token counts a worker remembers: in two generations, of which the older goes when the younger is full.
REMEMBERED_BYTES = 160 << 20
#: Longest segment, in characters, that is remembered, and what an entry takes beside its characters.
SHORT, ENTRY_BYTES = 64, 160


class Segmented:
    """A tokenizer of the tokenizers library with what is proven of its boundaries.

    ``rule`` is "after" where the normaliser and the pre-tokenizer drop white space
    (a boundary follows white space and precedes a character that is none),
    "before" for the byte-level pattern (a boundary precedes a single space between
    two characters that are no white space), else "" (none is proven).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.rule = proven_rule(config)
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.memo_bytes = 0

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def stable(self, text: str, p: int) -> bool:
        if self.rule == "after":
            return text[p - 1] in " \n\t\r" and not text[p].isspace()
        if self.rule == "before":
            return text[p] == " " and not text[p - 1].isspace() and p + 1 < len(text) and not text[p + 1].isspace()
        return False

    def segments(self, text: str) -> list[str] | None:
        """The text cut at stable boundaries; None where that isn't plain."""
        if self.rule == "after":
            # str.split() also cuts at these four, which the pattern does not take for white space
            if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
                return None
            return text.split()
        if self.rule == "before" and not re.search(r" (?:\s|$)", text):
            first, *rest = text.split(" ")
            return [first, *(" " + x for x in rest)]
        return None

    def count_one(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """Token counts of texts of one chunk each; segments not met before are encoded together."""
        get, older, cut = self.memo.get, self.older, [self.segments(x) for x in texts]
        counts = [None if words is None else list(map(get, words)) for words in cut]
        new = {w for words, found in zip(cut, counts, strict=True) if found is not None and None in found for w, n in zip(words, found, strict=True) if n is None}
        lengths = {w: older[w] for w in new if w in older} if older else {}
        fresh = list(new.difference(lengths))
        lengths.update(zip(fresh, map(len, self.tokenizer.encode_batch(fresh, add_special_tokens=False)), strict=True))
        out = []
        for text, words, found in zip(texts, cut, counts, strict=True):
            if found is None:
                out.append(len(self.tokenizer.encode(text, add_special_tokens=False)))
            elif None in found:
                out.append(sum(lengths[w] if n is None else n for w, n in zip(words, found, strict=True)))
            else:
                out.append(sum(found))
        kept = {w: n for w, n in lengths.items() if len(w) <= SHORT}
        size = ENTRY_BYTES * len(kept) + 4 * sum(map(len, kept))
        if self.memo_bytes + size > REMEMBERED_BYTES // 2:
            self.older, self.memo, self.memo_bytes = self.memo, {}, 0
        if size <= REMEMBERED_BYTES // 2:
            self.memo.update(kept)
            self.memo_bytes += size
        return out


def proven_rule(config: dict) -> str:
    """Reads from a tokenizer's configuration which boundaries are stable; "" unless every part of it is known to leave them so.

    An added token that holds white space, or takes in what is around it, could reach
    over a boundary, and so could a normaliser that rewrites more than runs of white
    space into a space, a character into its lower case or its composed form.
    """
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") or any(c.isspace() for c in x["content"]) for x in config.get("added_tokens") or []):
        return ""
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "before"
    steps = pre.get("pretokenizers", [])
    norms = (norm or {}).get("normalizers", []) if norm is None or norm.get("type") == "Sequence" else [norm]
    first = steps[0] if steps else {}
    # the pattern's alternatives match no white space, so what separates words is white space or nothing
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and matches_no_space((first.get("pattern") or {}).get("Regex", ""))
    local = all(x.get("type") in ("NFC", "Lowercase") or (x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " ") for x in norms)
    return "after" if drops and local and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in steps[1:]) else ""


def matches_no_space(pattern: str) -> bool:
    """Whether each alternative of a pattern is plain letters after an apostrophe, or one class of characters that leaves white space out."""
    known = re.compile(r"'[a-z]+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+?")
    return bool(pattern) and all(known.fullmatch(x) for x in pattern.split("|"))


class Pieces:
    """A sentencepiece model; no boundary is proven, so that a text is encoded as a whole."""

    rule = ""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return [(x.begin, x.end) for x in self.model.encode(text, out_type="immutable_proto").pieces]

    def stable(self, text: str, p: int) -> bool:
        return False

    def count_one(self, text: str) -> int:
        return len(self.model.encode(text))

    def count_all(self, texts: list[str]) -> list[int]:
        return [self.count_one(x) for x in texts]


@lru_cache(maxsize=2)
def load(path: str) -> Segmented | Pieces:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run beside one another as it is
    return Pieces(path) if path.endswith(".model") else Segmented(path)


def count_tokens(encoder, text: str, chunk_chars: int = 32_768, overlap_chars: int = 512) -> tuple[int, int, int]:
    """Tokens of a text, the chunks it took and how often an overlap was widened."""
    if len(text) <= chunk_chars or not encoder.rule:
        return encoder.count_one(text), 1, 0
    total, chunks, widened = 0, 1, 0
    # left: the open chunk [start, end), whose tokens from `begin` on are not counted yet
    start, end = 0, chunk_chars
    begin = 0
    left = encoder.offsets(text[start:end])
    while end < len(text):
        overlap = overlap_chars
        while True:
            if overlap >= end - max(start, begin):
                # as wide as the open chunk itself: both are encoded as one, up to twice as far
                start = max(start, begin)
                end = min(len(text), start + 2 * (end - start))
                left = encoder.offsets(text[start:end])
                chunks, widened = chunks + 1, widened + 1
                break
            at, to = end - overlap, min(len(text), end - overlap + chunk_chars)
            if to <= end:
                to = min(len(text), end + chunk_chars)
            right = encoder.offsets(text[at:to])
            chunks += 1
            p = common_boundary(encoder, text, start, left, at, right, end)
            if p is not None:
                total += sum(1 for s, _ in left if begin <= s + start < p)
                start, end, begin, left = at, to, p, right
                break
            overlap, widened = 2 * overlap, widened + 1
    return total + sum(1 for s, _ in left if s + start >= begin), chunks, widened


def common_boundary(encoder, text: str, start: int, left: list, at: int, right: list, end: int) -> int | None:
    """A stable boundary in (at, end) where both chunks start a token; they must agree on all tokens of the overlap up to the last such boundary."""
    ours = [s + start for s, _ in left if at < s + start < end]
    theirs = {s + at for s, _ in right if at < s + at < end}
    both = [p for p in ours if p in theirs and encoder.stable(text, p)]
    if len(both) < 2:
        return None
    low, high = both[0], both[-1]
    if [p for p in ours if low <= p < high] != sorted(p + at for p, _ in right if low <= p + at < high):
        return None
    return low


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = 32_768, overlap_chars: int = 512) -> DataFrame:
    """Token counts of whole texts, as the tokenizer's library gives them, without added special tokens.

    Returns id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_chunks
    and n_widened. A null text counts as empty: 0 bytes, 0 tokens. Ids may be null
    or repeat; each row gives a row, an empty table none. Other columns of ``docs`` are not read. There
    is no shuffle: a text is counted where it was read.
    """

    def make():
        encoder = load(tokenizer)

        def apply(texts):
            whole = [i for i, x in enumerate(texts) if len(x) <= chunk_chars]
            counts = dict(zip(whole, encoder.count_all([texts[i] for i in whole]), strict=True))
            found = [(counts[i], 1, 0) if i in counts else count_tokens(encoder, x, chunk_chars, overlap_chars) for i, x in enumerate(texts)]
            return [[f[i] for f in found] for i in range(3)]

        return apply

    docs = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("__t"))
    counted = map_texts(docs, [id_col, "n_bytes"], "__t", [field("n_tokens", T.LongType()), field("n_chunks", T.LongType()), field("n_widened", T.LongType())], make)
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks", "n_widened")
