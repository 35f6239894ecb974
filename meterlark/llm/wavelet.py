"""A wavelet matrix over token ids: bit-planes, most significant first, each stably partitioned.

``to_bytes`` makes one compressed file: a header, the number of zeros of each plane, a directory with the
place and the ones before it of each block of ``BLOCK_BITS`` bits, and the blocks, compressed one by one. A
reader inflates the blocks it asks for and no others: one a plane for ``access`` and two for ``rank``.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WMX2"
_HEAD = struct.Struct("<4sIQI")
BLOCK_BITS = 1 << 15
#: Inflated blocks that a plane keeps.
KEPT = 64


class _Plane:
    """One bit-plane with rank and select over blocks that ``load`` gives."""

    def __init__(self, n: int, ones_before: np.ndarray, load):
        self.n, self.ones_before, self.load = n, ones_before, load
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of a block and the ones before each of them in it."""
        found = self.blocks.get(k)
        if found is None:
            if len(self.blocks) >= KEPT:
                self.blocks.pop(next(iter(self.blocks)))
            words = self.load(k)
            found = self.blocks[k] = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return found

    def words(self) -> np.ndarray:
        return np.concatenate([self.load(k) for k in range(len(self.ones_before) - 1)] + [np.zeros(1, np.uint64)])

    def bit(self, i: int) -> int:
        at = i % BLOCK_BITS
        return int(self.block(i // BLOCK_BITS)[0][at >> 6] >> np.uint64(at & 63)) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        k, at = divmod(i, BLOCK_BITS)
        if not at:
            return int(self.ones_before[k])
        words, before = self.block(k)
        part = int(words[at >> 6]) & ((1 << (at & 63)) - 1) if at & 63 else 0
        return int(self.ones_before[k] + before[at >> 6]) + part.bit_count()

    def ranks1(self, places: np.ndarray) -> np.ndarray:
        """``rank1`` of many places; inflates the plane."""
        words = self.words()
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return before[places >> 6] + np.bitwise_count(words[places >> 6] & mask)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero."""
        starts = np.minimum(np.arange(len(self.ones_before)) * BLOCK_BITS, self.n)
        upto = self.ones_before if bit else starts - self.ones_before
        b = int(np.searchsorted(upto, k, "right")) - 1
        words, before = self.block(b)
        left = k - int(upto[b])
        inside = before if bit else np.arange(len(before)) * 64 - before
        w = int(np.searchsorted(inside, left, "right")) - 1
        left, value = left - int(inside[w]), int(words[w])
        value = value if bit else ~value & ((1 << 64) - 1)
        for _ in range(left):
            value &= value - 1
        return b * BLOCK_BITS + w * 64 + (value & -value).bit_length() - 1


class WaveletMatrix:
    def __init__(self, planes: list[_Plane], zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        now = np.ascontiguousarray(ids, np.uint32)
        n, levels = len(now), max(1, int(now.max()).bit_length() if len(now) else 1)
        now = now.astype(np.uint16) if levels <= 16 else now
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            ones = now & now.dtype.type(1 << level) != 0
            words = np.zeros(-(-n // BLOCK_BITS) * BLOCK_BITS // 64, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            words = words.reshape(-1, BLOCK_BITS // 64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).sum(axis=1, dtype=np.int64))])
            planes.append(_Plane(n, before, words.__getitem__))
            low = now[~ones]
            zeros.append(len(low))
            now = np.concatenate([low, now[ones]])
        return cls(planes, zeros, n)

    def to_bytes(self) -> bytes:
        import zstandard

        pack, blocks = zstandard.ZstdCompressor(level=1).compress, []
        for plane in self.planes:
            for k in range(len(plane.ones_before) - 1):
                raw = plane.load(k).tobytes()
                packed = pack(raw)
                blocks.append(packed if len(packed) < len(raw) else raw)
        ends = np.cumsum([0, *map(len, blocks)], dtype="<u8")
        head = [np.array(self.zeros, "<u8"), *(p.ones_before.astype("<u8") for p in self.planes), ends]
        return _HEAD.pack(MAGIC, len(self.planes), self.n, BLOCK_BITS) + b"".join(x.tobytes() for x in head) + b"".join(blocks)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        import zstandard

        magic, levels, n, bits = _HEAD.unpack_from(data)
        if magic != MAGIC or bits != BLOCK_BITS:
            raise ValueError("not a wavelet matrix")
        each, at = -(-n // bits), _HEAD.size
        zeros = np.frombuffer(data, "<u8", levels, at).tolist()
        before = np.frombuffer(data, "<u8", levels * (each + 1), at + 8 * levels).astype(np.int64).reshape(levels, each + 1)
        at += 8 * levels * (each + 2)
        ends = np.frombuffer(data, "<u8", levels * each + 1, at).astype(np.int64)
        body, unpack = at + 8 * len(ends), zstandard.ZstdDecompressor().decompress

        def load(block: int) -> np.ndarray:
            raw = data[body + ends[block] : body + ends[block + 1]]
            return np.frombuffer(raw if len(raw) == bits // 8 else unpack(raw, max_output_size=bits // 8), np.uint64)

        def plane(level: int) -> _Plane:
            return _Plane(n, before[level], lambda k: load(level * each + k))

        return cls([plane(level) for level in range(levels)], zeros, n)

    def decode(self) -> np.ndarray:
        """All ids in order: the partitions are undone from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k].words().view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[~ones] = now[: self.zeros[k]]
            up[ones] = now[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k))
            now = up
        return now

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for plane, zeros in zip(self.planes, self.zeros):
            bit = plane.bit(i)
            out = out << 1 | bit
            i = zeros + plane.rank1(i) if bit else i - plane.rank1(i)
        return out

    def _span(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's run begins in the last order, and how many are among the first i."""
        low, high = 0, i
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            if token >> (len(self.planes) - 1 - k) & 1:
                low, high = zeros + plane.rank1(low), zeros + plane.rank1(high)
            else:
                low, high = low - plane.rank1(low), high - plane.rank1(high)
        return low, high - low

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token among the first i ids."""
        return self._span(token, i)[1]

    def ranks(self, token: int, places: np.ndarray) -> np.ndarray:
        """``rank`` of many places at once."""
        if token < 0 or token >> len(self.planes) or not self.n:
            return np.zeros(len(places), np.int64)
        at = np.concatenate([[0], places]).astype(np.int64)
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.ranks1(at)
            at = zeros + ones if token >> (len(self.planes) - 1 - k) & 1 else at - ones
        return at[1:] - at[0]

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        low, n = self._span(token, self.n)
        if not 0 <= k < n:
            raise IndexError(k)
        at = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self.planes[level].select(bit, at - self.zeros[level] * bit)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]
