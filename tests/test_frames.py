"""Frame composition against plain Python, and its two gates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazeframe.functions import geo
from hazeframe.operators import coast, frames

TILING = frames.Tiling(coast.Lattice(33, 25), 4, 2)
FIRST, SECOND = frames.Geographic(-150.0, 75.0, 10.0, 8.0), frames.Lambert(46, 30, 120000.0)


def plain_grid(lon, lat):
    """Lambert place by the textbook formula."""
    n = math.sin(math.radians(geo.LAT0))
    f = math.cos(math.radians(geo.LAT0)) * math.tan(math.pi / 4 + math.radians(geo.LAT0) / 2) ** n / n
    at = lambda lo, la: (geo.RADIUS * f / math.tan(math.pi / 4 + math.radians(la) / 2) ** n, n * math.radians(lo - geo.LOV))
    (r0, t0), (r, t) = at(geo.LON1, geo.LAT1), at(lon, lat)
    return (r * math.sin(t) - r0 * math.sin(t0)) / SECOND.metres, (r0 * math.cos(t0) - r * math.cos(t)) / SECOND.metres


def plain_sample(cells, x, y):
    total = weight = 0.0
    for i in (0, 1):
        for j in (0, 1):
            w = abs(1 - i - (x - math.floor(x))) * abs(1 - j - (y - math.floor(y)))
            v = cells.get((math.floor(x) + i, math.floor(y) + j))
            if w > 0 and v is not None and math.isfinite(v) and v >= 0:
                total, weight = total + v * w, weight + w
    return total / weight if weight else None


def plain_pixel(first, second, x, y):
    lon, lat = TILING.lattice.west + x * TILING.lattice.lon_step, TILING.lattice.north - y * TILING.lattice.lat_step
    a = plain_sample(first, (lon - FIRST.lon0) / FIRST.dx, (FIRST.lat0 - lat) / FIRST.dy)
    bx, by = plain_grid(lon, lat)
    inside = 0 <= bx <= SECOND.nx - 1 and 0 <= by <= SECOND.ny - 1
    b = plain_sample(second, bx, by) if inside else None
    t = min(1.0, max(0.0, min(bx, SECOND.nx - 1 - bx, by, SECOND.ny - 1 - by) * SECOND.metres / 1000 / 200)) if inside else 0.0
    w = t * t * (3 - 2 * t)
    if a is not None and b is not None:
        return a + w * max(b - a, 0), 3 if b > a and w > 0 else 1
    return (a, 1) if a is not None else (b, 2) if b is not None else (None, 0)


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(6)
    odd = lambda: rng.choice([rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(0, 300), None, float("nan"), -5.0])
    first = {h: {(x, y): odd() for x in range(12) for y in range(10)} for h in (0, 1, 2)}
    second = {h: {(x, y): odd() for x in range(46) for y in range(30)} for h in (0, 1)}  # the third hour has one field only
    table = lambda f: spark.createDataFrame([(h, x, y, v) for h, c in f.items() for (x, y), v in c.items()], "hour int, cx int, cy int, value double")
    covered = TILING.lattice.cells(spark).where("(x + 2 * y) % 7 <> 0")
    return first, second, table(first), table(second), spark.createDataFrame([(0,), (1,), (2,)], "hour int"), covered


def made(inputs):
    _, _, a, b, hours, covered = inputs
    return frames.compose(a, b, hours, covered, TILING, FIRST, SECOND)


def test_frames_match_plain_python(spark, inputs):
    first, second, _, _, hours, covered = inputs
    got = frames.checked(made(inputs), hours, covered, TILING).collect()
    seen = set()
    for r in got:
        value, code = plain_pixel(first[r["hour"]], second.get(r["hour"], {}), r["x"], r["y"])
        assert r["code"] == code and (r["value"] is None) == (value is None)
        assert value is None or r["value"] == pytest.approx(value, rel=1e-9)
        sx, sy = TILING.strides
        assert (r["tile"] % 4 * sx + r["px"], r["tile"] // 4 * sy + r["py"]) == (r["x"], r["y"]) and 0 <= r["px"] <= sx and 0 <= r["py"] <= sy
        seen.add((r["hour"], r["tile"], r["px"], r["py"]))
    due = {(h, ty * 4 + tx, px, py) for h in (0, 1, 2) for ty in range(2) for tx in range(4) for px in range(9) for py in range(13) if (tx * 8 + px + 2 * (ty * 12 + py)) % 7}
    assert seen == due and len(got) == len(due)
    small = {(r["hour"], r["x"], r["y"]): r["value"] for r in frames.base(made(inputs)).collect()}
    assert len(small) == 3 * sum((4 * x + 8 * y) % 7 != 0 for x in range(9) for y in range(7))


def test_one_field_alone_and_none(spark, inputs):
    _, _, a, b, hours, covered = inputs
    only = frames.compose(None, b, hours, covered, TILING, FIRST, SECOND)
    assert {r["code"] for r in only.select("code").distinct().collect()} == {0, 2}
    neither = frames.compose(None, None, hours, covered, TILING, FIRST, SECOND)
    assert neither.where("value IS NOT NULL OR code <> 0").count() == 0


def test_seam_gate_fails_the_write(spark, inputs, tmp_path):
    _, _, _, _, hours, covered = inputs
    off = made(inputs).withColumn("value", F.when((F.col("tile") == 1) & (F.col("px") == 0), F.lit(1.0)).otherwise(F.col("value")))
    with pytest.raises(ValueError, match="seam"):
        frames.written_frames(off, hours, covered, TILING, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_completeness_gate_fails_the_write(spark, inputs, tmp_path):
    _, _, _, _, hours, covered = inputs
    for lost in ("NOT (hour = 1 AND tile = 5 AND px = 3)", "hour <> 2", "tile <> 7"):
        with pytest.raises(ValueError, match="incomplete"):
            frames.written_frames(made(inputs).where(lost), hours, covered, TILING, str(tmp_path / "out"))
    twice = made(inputs).unionByName(made(inputs).where("tile = 2 AND hour = 0"))
    with pytest.raises(ValueError, match="incomplete"):
        frames.checked(twice, hours, covered, TILING)
    assert not (tmp_path / "out").exists()


def test_written_frames_are_read_back(spark, inputs, tmp_path):
    _, _, _, _, hours, covered = inputs
    frames.written_frames(made(inputs), hours, covered, TILING, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "tiles")).count() == made(inputs).count()
    assert spark.read.parquet(str(tmp_path / "out" / "base")).count() == frames.base(made(inputs)).count()
    with pytest.raises(ValueError, match="border"):
        frames.Tiling(coast.Lattice(34, 25), 4, 2)
