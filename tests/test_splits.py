"""Large csv files read by byte ranges, against the single reader."""

import hashlib
import io
import random

import pytest

from wakeline.functions.parsing import CURRENT, HEADERS
from wakeline.sources import rawtext, splits

WIDTH = len(HEADERS[CURRENT])
FIELDS = ["", "a", "é", '"q"', '"a,b"', '"two\nlines"', '"two\r\nlines"', '"\r"', '"say ""x"""', '""', '""""', '"\n\n"', 'in"side', 'end"', 'a""b', '","', '"\n"",\n"']


def text_of(rng: random.Random, records: int, bom: bool = False) -> bytes:
    header = list(HEADERS[CURRENT])
    rng.shuffle(header)
    lines = [",".join(f'"{h}"' if rng.random() < 0.3 else h for h in header)]
    lines += [",".join(rng.choice(FIELDS) for _ in range(WIDTH)) if rng.random() < 0.8 else "" for _ in range(records)]
    if rng.random() < 0.3:
        lines.insert(0, "")
    text = "".join(line + rng.choice(["\n", "\r\n", "\r"]) for line in lines)
    return (b"\xef\xbb\xbf" if bom else b"") + (text if rng.random() < 0.5 else text.rstrip("\r\n")).encode()


def single(data: bytes) -> list[tuple]:
    lines = rawtext.Lines(io.TextIOWrapper(io.BytesIO(data), encoding="utf-8-sig", newline=""), 10**6)
    records = rawtext.records_of(lines)
    order, width, _ = rawtext.header_of(records, CURRENT)
    return [(a, b, *f) for a, b, f in rawtext.rows_of(records, order, width, 10**6)]


def ranged(data: bytes, path, cuts: list[int]) -> list[tuple]:
    """The two passes without Spark, for any cuts."""
    path.write_bytes(data)
    state, lines, before, out = 0, 0, 0, []
    with open(path, "rb") as file:
        for begin, end in zip(cuts, cuts[1:]):
            s = splits.summarised(file, begin, end)
            if s["first"][state] is not None:
                row = rawtext.rows_between(str(path), CURRENT, s["first"][state], end, 1 + lines + s["above"][state], before, 10**6, 10**6)
                out += [(a, b, *f) for a, b, f in row]
            lines, before, state = lines + s["lines"], before + s["records"][state], s["after"][state]
    assert before == len(out) + 1  # the count that caps rest on
    return out


@pytest.mark.parametrize("seed", range(6))
def test_every_cut(tmp_path, seed):
    rng = random.Random(seed)
    data = text_of(rng, 6, bom=seed % 3 == 0)
    want = single(data)
    for cut in range(4, len(data)):
        assert ranged(data, tmp_path / "f.csv", [0, cut, len(data)]) == want, cut
    for _ in range(30):
        cuts = sorted(rng.sample(range(4, len(data)), 20))
        assert ranged(data, tmp_path / "f.csv", [0, *cuts, len(data)]) == want
    assert ranged(data, tmp_path / "f.csv", [0, *range(4, len(data) + 1)]) == want


def test_spark_reads_ranges_of_many_files(spark, tmp_path):
    rng, assets, want = random.Random(5), [], []
    for i in range(4):
        data = text_of(rng, (0, 3, 60, 200)[i], bom=i == 2)
        path = tmp_path / f"{i}.csv"
        path.write_bytes(data)
        assets.append(dict(path=str(path), asset_id=f"a{i}", sha256=hashlib.sha256(data).hexdigest()))
        want += [(f"a{i}", *row) for row in single(data)]
    for size in (64, 1000, 1 << 20):
        got = rawtext.read_positions(spark, CURRENT, assets, split_bytes=size)
        assert sorted(map(tuple, got.collect())) == sorted(want), size
    assert rawtext.read_positions(spark, CURRENT, assets, split_bytes=500).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("fault", ["width", "quote", "sha", "header", "records", "characters", "bytes", "text after quote", "none"])
def test_faults_in_a_late_range_fail(spark, tmp_path, fault):
    header = ",".join(HEADERS[CURRENT])
    good = ",".join(["x"] * WIDTH)
    data = "\n".join([header.replace("mmsi", "MMSI") if fault == "header" else header] + [good] * 300)
    data += {"width": "\na,b", "quote": '\n"open,', "text after quote": "\n" + good[:-1] + '"y"z', "characters": "\n" + good + "x" * 500}.get(fault, "")
    path = tmp_path / "f.csv"
    path.write_text(data + "\n")
    caps = {"records": dict(max_records=299), "characters": dict(max_record_characters=400), "bytes": dict(max_decoded_bytes=1000)}.get(fault, {})
    asset = dict(path=str(path), asset_id="f", sha256="0" * 64 if fault == "sha" else None)

    def read() -> int:
        return len(rawtext.read_positions(spark, CURRENT, [asset], split_bytes=512, **caps).collect())

    if fault == "none":
        assert read() == 300
        return
    with pytest.raises(Exception):
        read()
