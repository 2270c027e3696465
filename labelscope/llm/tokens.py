"""Token ids of whole texts by a word-level BPE tokenizer file, with remembered words."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

#: Other stretches, and words, that a worker remembers, together (some 250 bytes each).
STRETCHES, WORDS = 400_000, 700_000
#: Longer ones, in bytes, are remembered for one part of the text only.
LONGEST = 64
#: Text that is encoded at a time.
PART_BYTES = 8 << 20
SPACE, LETTER, MARK, OTHER = range(4)
#: Kinds of bytes: ASCII letters and what follows 0xC3 in Latin-1 letters (0x97 and 0xB7 end signs); ASCII marks
#: but no apostrophe. A stretch with any other byte is never plain.
KINDS = bytes(
    SPACE if b in b"\t\n\v\f\r " else MARK if b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    else LETTER if chr(b).isalpha() and b < 128 or b == 0xC3 or 0x80 <= b < 0xC0 and b not in (0x97, 0xB7)
    else OTHER for b in range(256))
BLANKS = bytes(32 if kind == SPACE else b for b, kind in enumerate(KINDS))
#: Lower case of plain stretches, where 0x80 to 0x9E follow 0xC3.
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
WORD = re.compile(rb" [a-z\xc3\x80-\x96\x98-\xb6\xb8-\xbf]+ *").fullmatch


class TextIds:
    """Ids of a text as little-endian unsigned 32-bit integers.

    For tokenizers that lower-case, drop white space, close every word with
    ``</w>`` and never let a token reach across white space: a text's ids are
    those of its stretches in turn. A plain stretch (Latin-1 letters, then ASCII
    marks but no apostrophe) is two pre-tokens whatever stands around them, so its
    letters, in lower case, and its marks are remembered apart; any other stretch
    is remembered whole. New words are encoded together in one call and parted at
    the closing tokens. What was last used longest ago is dropped first, half at a time.
    """

    def __init__(self, path: str, stretches: int = STRETCHES, words: int = WORDS, part_bytes: int = PART_BYTES):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        # the same merges for words that are lower-cased and parted already
        self._merges = Tokenizer(self._tokenizer.model)
        self._merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._most = stretches + words
        self.part_bytes = part_bytes
        self.forget()
        self._closes = np.zeros(self._tokenizer.get_vocab_size(), bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._closes[i] = token.endswith("</w>")

    def _each(self, stretches: list[bytes]) -> list[bytes]:
        import numpy as np

        encoded = self._tokenizer.encode_batch_fast([x.strip(b" ").decode("utf-8") for x in stretches], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one pre-token each, with a space in front."""
        import numpy as np

        if not words:
            return []
        ids = np.array(self._merges.encode_batch_fast([b"".join(words).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self._closes[ids]) + 1
        if len(ends) != len(words):
            return self._each(words)
        flat, ends = ids.tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _remember(self, seen: list[bytes]) -> dict[bytes, bytes]:
        """Ids of all parts seen, new ones included."""
        for x in self._long:
            del self._known[x]
        if 2 * len(self._known) > self._most:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        new = [x for x in seen if x not in known]
        if older:
            known.update((x, older[x]) for x in new if x in older)
            new = [x for x in new if x not in known]
        words = [x for x in new if WORD(x)]
        known.update(zip(words, self._together(words)))
        rest = [x for x in new if x not in known]
        known.update(zip(rest, self._each(rest)))
        self._long = [x for x in new if len(x) > LONGEST]
        return known

    def forget(self) -> None:
        """Drop all that is remembered."""
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._long: list[bytes] = []

    def encode(self, texts) -> Iterator[memoryview]:
        """Ids of each text of an Arrow string array; nulls are empty texts."""
        import numpy as np
        import pyarrow.compute as pc

        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):  # parts of some megabytes, or one text
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + self.part_bytes, side="right")))
            yield from self._encode_part(pc.fill_null(texts.slice(at, upto - at), ""))
            at = upto

    def _encode_part(self, texts) -> Iterator[memoryview]:
        import numpy as np
        import pyarrow as pa

        items = texts.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        whole = b" ".join([b"", *items]).translate(BLANKS)
        kinds = np.frombuffer(whole.translate(KINDS), np.uint8)
        before, kind = kinds[:-1], kinds[1:]
        # a stretch starts at the last space before it
        starts = np.flatnonzero((before == SPACE) & (kind != SPACE))
        if not len(starts):
            yield from [memoryview(b"")] * len(items)
            return
        odd = (kind == OTHER) | ((kind == MARK) & (before == SPACE)) | ((kind == LETTER) & (before == MARK))
        odd = np.maximum.reduceat(odd, starts)
        data = np.frombuffer(whole.translate(LOWER), np.uint8)
        marks = np.flatnonzero((before == LETTER) & (kind == MARK)) + 1
        if odd.any():  # kept as they are, in one piece
            edges = np.append(starts, len(whole))
            data = np.where(np.repeat(np.append(False, odd), np.diff(edges, prepend=0)), np.frombuffer(whole, np.uint8), data)
            marks = marks[~odd[np.searchsorted(starts, marks) - 1]]
        cuts = np.sort(np.concatenate([starts, marks]), kind="stable")
        offsets = np.append(cuts, len(whole)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        seen = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._remember(seen)
        ids = pa.array(list(map(known.__getitem__, seen)), pa.binary()).take(parts.indices)
        _, offsets, data = ids.buffers()
        # a text starts at the space that was put in front of it
        first = np.cumsum([0, *(len(x) + 1 for x in items)])
        ends = np.frombuffer(offsets, np.int32)[ids.offset:ids.offset + len(ids) + 1][np.searchsorted(cuts, first)].tolist()
        view = memoryview(data)
        for a, b in zip(ends, ends[1:]):
            yield view[a:b]


def grouped(batches, most_bytes: int) -> Iterator:
    """Arrow batches with rows, short ones put together up to `most_bytes`."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most_bytes:
            whole, held, size = pa.concat_batches(held), [], 0
            yield whole
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def text_ids(path: str, stretches: int = STRETCHES, words: int = WORDS, part_bytes: int = PART_BYTES) -> TextIds:
    """One encoder for each worker process and file."""
    return TextIds(path, stretches, words, part_bytes)
