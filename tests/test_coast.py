"""Sea filling and coastal ways against plain Python."""

import heapq
import math

import pytest
from pyspark.sql import functions as F

from hazeframe.operators import coast


def plain_sea(polygons, lattice):
    """Every lattice point against every ring, in painting order."""

    def inside(ring, x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if min(ay, by) <= y < max(ay, by) and ax + (y - ay) * ((bx - ax) / (by - ay)) <= x:
                hit = not hit
        return hit

    out = set()
    for x in range(lattice.width):
        for y in range(lattice.height):
            wet = False
            for rings in polygons:
                for k, ring in enumerate(rings):
                    places = [((a - lattice.west) / lattice.lon_step, (lattice.north - b) / lattice.lat_step) for a, b in ring]
                    if inside(places, x, y):
                        wet = k == 0
            if wet:
                out.add((x, y))
    return out


def plain_ways(water, lattice, km):
    """Dijkstra from all coastal points at once."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    within = lambda x, y: 0 <= x < lattice.width and 0 <= y < lattice.height
    best = {(x, y): 0.0 for x, y in water if any(within(x + i, y + j) and (x + i, y + j) not in water for i, j in steps)}
    heap = [(0.0, p) for p in best]
    heapq.heapify(heap)
    while heap:
        d, (x, y) = heapq.heappop(heap)
        if d > best[x, y]:
            continue
        for i, j in steps:
            to = (x + i, y + j)
            if to not in water:
                continue
            lat = lattice.north - (y + to[1]) * 0.5 * lattice.lat_step
            way = d + math.hypot(coast.EARTH_KM * math.radians(lattice.lat_step) * abs(j), coast.EARTH_KM * math.radians(lattice.lon_step) * math.cos(math.radians(lat)) * abs(i))
            if way <= km and way < best.get(to, math.inf):
                best[to] = way
                heapq.heappush(heap, (way, to))
    return best


BOX = {"west": -100.0, "east": -88.0, "south": 40.0, "north": 50.0}
SHAPES = [  # a sea with two islands, a lake dug into one of them, and land painted over the sea's corner
    [[(-101, 39), (-87, 39.3), (-86.5, 51), (-101.5, 50.7)], [(-98, 42), (-94, 42), (-94, 47), (-98, 46)], [(-92, 44), (-90, 45), (-91, 48)]],
    [[(-97, 43), (-95, 43), (-95.5, 45.5)]],
    [[(-89, 40), (-88, 40), (-88, 41)], [(-93.7, 41), (-93.2, 41), (-93.2, 48), (-93.7, 48)]],
    [[(-95, 44), (-95, 44), (-95, 44)]],
]


def frame(spark, shapes):
    rows = [(n, [[(float(a), float(b)) for a, b in ring] for ring in rings]) for n, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, "ord int, rings array<array<struct<lon:double,lat:double>>>")


@pytest.mark.parametrize("size", [(37, 31), (60, 55)])
def test_sea_with_holes_matches_a_walk_of_all_points(spark, size):
    lattice = coast.Lattice(*size, **BOX)
    got = {tuple(r) for r in coast.sea(frame(spark, SHAPES), lattice).collect()}
    assert got == plain_sea(SHAPES, lattice)
    wide = lattice.widened(3, 2)
    assert (round(wide.lon_step, 12), round(wide.lat_step, 12)) == (round(lattice.lon_step, 12), round(lattice.lat_step, 12))
    assert {tuple(r) for r in coast.sea(frame(spark, SHAPES), wide).collect()} == plain_sea(SHAPES, wide)


def test_closed_rings_and_no_polygons(spark):
    lattice = coast.Lattice(37, 31, **BOX)
    closed = [[[*ring, ring[0]] for ring in rings] for rings in SHAPES]
    assert {tuple(r) for r in coast.sea(frame(spark, closed), lattice).collect()} == plain_sea(SHAPES, lattice)
    assert coast.sea(frame(spark, []), lattice).count() == 0 and coast.sea(frame(spark, [[[]]]), lattice).count() == 0


def test_ways_match_dijkstra_through_a_strait(spark):
    lattice = coast.Lattice(24, 22, **BOX)
    water = {(x, y) for x in range(2, 23) for y in range(24) if y < 22} - {(x, 10) for x in range(24) if x not in (12, 13)} - {(5, 4), (6, 4)}
    df = spark.createDataFrame(sorted(water), "x int, y int")
    for km in (60.0, 200.0, 5000.0):
        got = {(r["x"], r["y"]): r["km"] for r in coast.from_coast(df, lattice, km).collect()}
        want = plain_ways(water, lattice, km)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_a_wall_makes_the_way_longer_than_the_straight_line(spark):
    """Two basins: the far one is reached through a gap only, so its middle lies beyond the limit."""
    lattice = coast.Lattice(41, 21, **BOX)
    water = {(x, y) for x in range(41) for y in range(21)} - {(0, 0)}
    got = {(r["x"], r["y"]) for r in coast.from_coast(spark.createDataFrame(sorted(water), "x int, y int"), lattice, 200.0).collect()}
    assert got == set(plain_ways(water, lattice, 200.0)) and (40, 20) not in got


def test_coverage_is_cut_from_its_halo_and_must_not_be_trivial(spark):
    lattice = coast.Lattice(40, 34, **BOX)
    columns, rows = lattice.halo(60.0)
    wide = lattice.widened(columns, rows)
    water = plain_sea(SHAPES, wide)
    near = plain_ways(water, wide, 60.0)
    got = {(r["x"], r["y"]): r["covered"] for r in coast.coverage(frame(spark, SHAPES), lattice, 60.0).collect()}
    assert got == {(x, y): (x + columns, y + rows) not in water or (x + columns, y + rows) in near for x in range(40) for y in range(34)}
    with pytest.raises(ValueError, match="coastal mask"):
        coast.coverage(frame(spark, SHAPES), lattice, 1e5)


def test_unsorted_rows_paint_by_order(spark):
    lattice = coast.Lattice(37, 31, **BOX)
    shuffled = frame(spark, SHAPES).orderBy(F.desc("ord"))
    assert {tuple(r) for r in coast.sea(shuffled, lattice).collect()} == plain_sea(SHAPES, lattice)
