"""Problem 6: how much of garbled text is restored exactly, by encodings and layers."""

import collections
import glob
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from skeinery.llm import mojibake as M

DATA = os.environ.get("RESTORE_DIR", "/root/testdata/sf0.01")
#: What the bytes were and as what they were read.
PAIRS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1253", "latin-1"), ("cp1254", "latin-1"), ("gbk", "latin-1"), ("cp932", "latin-1"), ("cp949", "latin-1"), ("big5", "latin-1")]


def decoded(raw, encoding):
    """As sloppy readers decode: bytes an encoding leaves undefined become C1 controls."""
    return "".join(bytes([b]).decode(encoding) if _has(b, encoding) else chr(b) for b in raw)


def _has(b, encoding):
    try:
        bytes([b]).decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def restoration(directory, most=4000):
    """``{(meant, read, layers): (restored, garbled)}`` of clean strings the counts have not seen."""
    table = pq.read_table(f"{directory}/torrents.parquet", columns=["name", "files"])
    rows = [[s for s in [n, *(f["path"] for f in fs or [])] if s and not s.isascii()] for n, fs in zip(table["name"].to_pylist(), table["files"].to_pylist())]
    counts = np.zeros(M._LEAST_SLOTS, np.float32)
    for strings in rows[::2]:
        for sequence, n in M.sequence_counts(strings).items():
            counts[M._code(sequence) & M._LEAST_SLOTS - 1] += n
    fixer = M.Repairer(M.Cost(counts))
    known = {s for strings in rows[::2] for s in strings}
    strings = sorted({s for strings in rows[1::2] for s in strings if M.LOST not in s} - known)
    clean = [s for s in strings if fixer.repair(s) == s]
    random.Random(1).shuffle(clean)
    found = collections.defaultdict(lambda: [0, 0])
    for s in clean[:most]:
        for meant, read in PAIRS:
            bad = s
            for layers in range(1, 4 if meant == "utf-8" else 2):
                try:
                    bad = decoded(bad.encode(meant), read)
                except UnicodeEncodeError:
                    break
                if bad == s or len(bad) > 400:
                    break
                found[meant, read, layers][0] += fixer.repair(bad) == s
                found[meant, read, layers][1] += 1
    return {k: tuple(v) for k, v in found.items()}


@pytest.fixture(scope="module")
def found():
    return restoration(DATA, 150)


def test_utf8_is_restored_through_all_layers(found):
    for layers in (1, 2, 3):
        ok, n = map(sum, zip(*(v for (meant, _, k), v in found.items() if meant == "utf-8" and k == layers)))
        assert n > 100 and ok >= 0.9 * n


def test_most_legacy_readings_are_restored(found):
    ok, n = map(sum, zip(*(v for (meant, _, _), v in found.items() if meant != "utf-8")))
    assert n > 100 and ok >= 0.6 * n


if __name__ == "__main__":
    for (meant, read, layers), (ok, n) in sorted(restoration(DATA).items()):
        print(f"{meant} read as {read}, {layers} layers: {ok} of {n}, {ok / n:.3f}")
