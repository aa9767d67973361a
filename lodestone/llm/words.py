"""Words of texts as numbers, for use within tasks: splitting, hashing, and batches of a bounded size."""

from __future__ import annotations

import contextlib
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Two primes below 2^32 and a base for each; a string's hash is a polynomial in its bytes modulo either.
FIELDS = ((4294967291, 2654435761), (4294967279, 2246822519))


def sliced(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut after at most ``most`` bytes of text or one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
        del batch
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on from task to task, and keeps what earlier ones have used."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers in order, the distinct words, and the text of each word; words lie between ASCII white space, null texts
    have none. ``lower`` turns A-Z to a-z first."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    coded = pc.dictionary_encode(words.filter(real))
    return coded.indices.to_numpy(), coded.dictionary, owner.filter(real).to_numpy().astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _powers(base: int, prime: int, bits: int) -> np.ndarray:
    """base^0, base^1, ... modulo prime, 2^bits of them."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < 1 << bits:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out


def string_hashes(strings: pa.Array, block: int = (1 << 17) - 1) -> np.ndarray:
    """A 64-bit hash of each string, from two polynomials modulo primes; strings are taken in blocks of about ``block`` bytes, so
    working memory doesn't follow the array."""
    import xxhash

    strings = pa.concat_arrays([strings]).cast(pa.large_string())
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out = np.empty(len(strings), np.uint64)
    begin = 0
    while begin < len(out):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + block, "right")) - 1)
        low, high = int(at[begin]), int(at[end])
        if high - low > block:  # one string longer than a block
            out[begin] = xxhash.xxh64_intdigest(raw[low:high].tobytes(), 1)
        else:
            size = at[begin : end + 1] - low
            part = raw[low:high].astype(np.uint64) + np.uint64(1)
            halves = []
            for prime, base in FIELDS:
                p = np.uint64(prime)
                bits = block.bit_length()
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(part * _powers(base, prime, bits)[: high - low] % p, out=sums[1:])
                back = _powers(pow(base, -1, prime), prime, bits)[size[:-1]]
                halves.append((sums[size[1:]] - sums[size[:-1]]) % p * back % p)
            out[begin:end] = mixed((halves[0] << np.uint64(32) | halves[1]) + np.diff(size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        begin = end
    return out


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word hashes."""
    size = max(0, len(words) - n + 1)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD1342543DE82EF95) + words[k : k + size]
    return mixed(total + np.uint64(n))
