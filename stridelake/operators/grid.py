"""Graphs on grid maps: cells, edges, distances, paths, components, pair difficulty, mazes.

A map has at most a few hundred cells, so a whole map is one bounded row; maps are
what is distributed.  Structure that SQL expresses (cells, edges, degrees, components by label
spreading) is DataFrame code; ordered searches run on one map's cells in an Arrow batch.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Cell = tuple[int, int]
#: The neighbour order, and the constants of the path difficulty.
STEPS: tuple[Cell, ...] = ((-1, 0), (1, 0), (0, -1), (0, 1))
BATCH_ROWS = 20_000
LENGTH_SCALE, W_LENGTH, W_BRANCH, W_DETOUR, TOP_SHARE = 20.0, 0.4, 0.3, 0.3, 0.10
#: Weight and full mark of each part of the static difficulty.
STATIC_PARTS = {"path": (0.28, 2.5), "turn": (0.14, 0.45), "junction": (0.14, 0.25), "articulation": (0.12, 0.30), "deadend": (0.10, 0.25), "bridge": (0.10, 0.60), "wall": (0.07, 0.65), "cycle": (0.05, 0.20)}


def free_cells(cells: DataFrame) -> DataFrame:
    return cells.filter("is_free").select("map_id", "row", "col")


def edges(cells: DataFrame) -> DataFrame:
    """Directed edges between free neighbours, with the direction's rank: (map_id, row, col, nrow, ncol, dir)."""
    f = free_cells(cells)
    steps = F.array(*(F.struct(F.lit(i).alias("dir"), F.lit(a).cast("long").alias("dr"), F.lit(b).cast("long").alias("dc")) for i, (a, b) in enumerate(STEPS)))
    out = f.withColumn("s", F.explode(steps)).select("map_id", "row", "col", (F.col("row") + F.col("s.dr")).alias("nrow"), (F.col("col") + F.col("s.dc")).alias("ncol"), F.col("s.dir").alias("dir"))
    return out.join(f.select("map_id", F.col("row").alias("nrow"), F.col("col").alias("ncol")), ["map_id", "nrow", "ncol"]).select("map_id", "row", "col", "nrow", "ncol", "dir")


def degrees(cells: DataFrame) -> DataFrame:
    d = edges(cells).groupBy("map_id", "row", "col").agg(F.count(F.lit(1)).alias("degree"))
    return free_cells(cells).join(d, ["map_id", "row", "col"], "left").select("map_id", "row", "col", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def window_count(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Free windows of a size by map: each free cell speaks for the windows that it lies in."""
    f = free_cells(cells)
    span = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    o = f.withColumn("dr", F.explode(span(height))).withColumn("dc", F.explode(span(width)))
    full = o.groupBy("map_id", (F.col("row") - F.col("dr")).alias("r"), (F.col("col") - F.col("dc")).alias("c")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == height * width)
    maps = cells.select("map_id").distinct()
    return maps.join(full.groupBy("map_id").agg(F.count(F.lit(1)).alias("windows")), "map_id", "left").select("map_id", F.coalesce("windows", F.lit(0).cast("long")).alias("windows"))


class Graph:
    """One map's free cells and their neighbours in the fixed order."""

    def __init__(self, free: Iterable[Cell]):
        self.free = sorted(free)
        inside = set(self.free)
        self.near = {c: [n for dr, dc in STEPS if (n := (c[0] + dr, c[1] + dc)) in inside] for c in self.free}

    def search(self, start: Cell) -> tuple[dict[Cell, int], dict[Cell, Cell | None]]:
        """Distances and parents, first in first out."""
        dist, parent, queue = {start: 0}, {start: None}, deque([start])
        while queue:
            c = queue.popleft()
            for n in self.near[c]:
                if n not in dist:
                    dist[n], parent[n] = dist[c] + 1, c
                    queue.append(n)
        return dist, parent

    @staticmethod
    def path(parent: Mapping[Cell, Cell | None], goal: Cell) -> list[Cell] | None:
        if goal not in parent:
            return None
        out: list[Cell] = [goal]
        while (up := parent[out[-1]]) is not None:
            out.append(up)
        return out[::-1]

    def components(self) -> list[set[Cell]]:
        left, out = set(self.free), []
        for c in self.free:
            if c in left:
                found = set(self.search(c)[0])
                out.append(found)
                left -= found
        return out

    def diameter(self) -> tuple[int, Cell, Cell]:
        """The longest distance, with the first start in cell order and the largest goal."""
        best: tuple[int, Cell, Cell] | None = None
        for c in self.free:
            dist, _ = self.search(c)
            d, goal = max((d, g) for g, d in dist.items())
            if best is None or d > best[0]:
                best = (d, c, goal)
        if best is None:
            raise ValueError("the map has no free cell")
        return best

    def cuts(self) -> tuple[set[Cell], set[tuple[Cell, Cell]]]:
        """Articulation points and bridges, from discovery times and low points along an explicit stack."""
        time: dict[Cell, int] = {}
        low: dict[Cell, int] = {}
        points: set[Cell] = set()
        bridges: set[tuple[Cell, Cell]] = set()
        for root in self.free:
            if root in time:
                continue
            time[root] = low[root] = len(time)
            stack: list[tuple[Cell, Cell | None, Iterator[Cell]]] = [(root, None, iter(self.near[root]))]
            branches = 0
            while stack:
                c, up, rest = stack[-1]
                n = next(rest, None)
                if n is None:
                    stack.pop()
                    if up is not None:
                        low[up] = min(low[up], low[c])
                        if low[c] > time[up]:
                            bridges.add((min(c, up), max(c, up)))
                        if up == root:
                            branches += 1
                        elif low[c] >= time[up]:
                            points.add(up)
                elif n not in time:
                    time[n] = low[n] = len(time)
                    stack.append((n, c, iter(self.near[n])))
                elif n != up:
                    low[c] = min(low[c], time[n])
            if branches > 1:
                points.add(root)
        return points, bridges

    def corridors(self) -> list[int]:
        """Lengths of the runs of edges between cells that aren't of degree two, and of pure cycles."""
        used: set[frozenset[Cell]] = set()
        out = []

        def follow(a: Cell, b: Cell) -> int:
            n = 1
            used.add(frozenset((a, b)))
            while len(self.near[b]) == 2:
                onward = self.near[b][0] if self.near[b][0] != a else self.near[b][1]
                if frozenset((b, onward)) in used:
                    break
                used.add(frozenset((b, onward)))
                a, b, n = b, onward, n + 1
            return n

        ends_first = sorted(self.free, key=lambda c: (len(self.near[c]) == 2, c))
        for c in ends_first:
            out += [follow(c, n) for n in self.near[c] if frozenset((c, n)) not in used]
        return out


def away_steps(path: list[Cell]) -> int:
    """Steps that lead away from the goal, by city-block distance."""
    goal = path[-1]
    d = [abs(r - goal[0]) + abs(c - goal[1]) for r, c in path]
    return sum(b > a for a, b in zip(d, d[1:], strict=False))


def turns(path: list[Cell]) -> int:
    moves = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(path, path[1:], strict=False)]
    return sum(a != b for a, b in zip(moves, moves[1:], strict=False))


def distractors(graph: Graph, path: list[Cell], to_goal: Mapping[Cell, int]) -> tuple[int, int, float]:
    """Cells with exits that are on no shortest way (not counting the way back), those exits, and their mean share."""
    n = len(path) - 1
    if n <= 0:
        return 0, 0, 0.0
    exits = []
    for i, c in enumerate(path[:-1]):
        back = path[i - 1] if i else None
        exits.append(sum(1 for x in graph.near[c] if x != back and to_goal.get(x) != n - i - 1))
    share = sum(e / (2 if i else 3) for i, e in enumerate(exits))
    return sum(e > 0 for e in exits), sum(exits), share / n


def pair_records(graph: Graph, candidates: Iterable[Cell] | None = None) -> list[dict]:
    """All ordered reachable pairs with path metrics and difficulty, one by one (the plain twin of ``pair_arrays``)."""
    cells = sorted(set(candidates)) if candidates is not None else graph.free
    trees = {c: graph.search(c) for c in cells}
    out = []
    for s in cells:
        for g in cells:
            if s == g or (path := graph.path(trees[s][1], g)) is None:
                continue
            n, manhattan = len(path) - 1, abs(s[0] - g[0]) + abs(s[1] - g[1])
            points, exits, branch = distractors(graph, path, trees[g][0])
            length, detour, away = n / (n + LENGTH_SCALE), 1.0 - manhattan / n, away_steps(path)
            out.append(
                {
                    "start_row": s[0], "start_col": s[1], "goal_row": g[0], "goal_col": g[1], "path_len": n, "manhattan": manhattan, "away_steps": away,
                    "distractor_points": points, "distractor_exits": exits, "branch_score": branch, "length_score": length, "detour_score": detour,
                    "difficulty": W_LENGTH * length + W_BRANCH * branch + W_DETOUR * detour, "turns": turns(path),
                }
            )
    return out


PAIR_SCHEMA = (
    "map_id long, start_row int, start_col int, goal_row int, goal_col int, path_len int, manhattan int, away_steps int, distractor_points int, distractor_exits int, "
    "branch_score double, length_score double, detour_score double, difficulty double, turns int"
)


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all shuffle partitions: small as they are, adaptive execution would leave their long work to one task.

    Dealt by a hash of the key, as Spark drops a repartition by the key that rows are already grouped by.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))


def _packed(cells: DataFrame) -> DataFrame:
    """One row a map, with its free cells and its last row and column."""
    packed = cells.groupBy("map_id").agg(F.collect_list(F.when(F.col("is_free"), F.struct("row", "col"))).alias("free"), F.max("row").alias("maxr"), F.max("col").alias("maxc"))
    return _spread(packed, "map_id")


def _per_map(cells: DataFrame, kernel, schema: str) -> DataFrame:
    """Run a kernel on each map's free cells; one map is one row, so no cells are shuffled twice.  Rows leave by ``BATCH_ROWS`` or a map."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m, free, maxr, maxc in zip(b["map_id"], b["free"], b["maxr"], b["maxc"], strict=True):
                graph = Graph((int(c["row"]), int(c["col"])) for c in free)
                rows += [{"map_id": int(m), **r} for r in kernel(graph, int(maxr) + 1, int(maxc) + 1)]
                if len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return _packed(cells).mapInPandas(run, schema)


def pair_arrays(graph: Graph) -> dict[str, np.ndarray]:
    """The columns of ``pair_records``, in its order: all paths are walked together, from their goals up the starts' trees."""
    cells = sorted(set(graph.free))
    number = {c: i for i, c in enumerate(cells)}
    near = [[number[x] for x in graph.near[c]] for c in cells]
    size = len(cells)
    dist, parent = np.full((size, size), -1, np.int32), np.full((size, size), -1, np.int32)
    for s in range(size):
        d, up, queue = [-1] * size, [-1] * size, [s]
        d[s] = 0
        for c in queue:
            for x in near[c]:
                if d[x] < 0:
                    d[x], up[x] = d[c] + 1, c
                    queue.append(x)
        dist[s], parent[s] = d, up
    row, col = (np.array([c[i] for c in cells], np.int32) for i in (0, 1))
    # exits[g, c]: neighbours of c that are on no shortest way from it to g
    exits = np.zeros((size, size), np.int32)
    for c, xs in enumerate(near):
        for x in xs:
            exits[:, c] += dist[:, x] != dist[:, c] - 1
    at = np.array([number[c] for c in graph.free], np.int64)
    s, g = np.repeat(at, len(at)), np.tile(at, len(at))
    found = (s != g) & (dist[s, g] >= 0)
    s, g = s[found], g[found]
    order = np.argsort(-dist[s, g], kind="stable")  # the longest first, so those still on their way are the first ones
    s, g = s[order], g[order]
    n = dist[s, g]
    away, points, total, bends = (np.zeros(len(s), np.int32) for _ in range(4))
    c, move = g, np.zeros(0, np.int64)
    city = lambda a, b: np.abs(row[a] - row[b]) + np.abs(col[a] - col[b])
    left = city(c, g)
    for step in range(int(n.max(initial=0))):
        k = int(np.searchsorted(-n, -step, side="left"))  # paths of more than ``step`` steps
        c, left = c[:k], left[:k]
        up = parent[s[:k], c]
        e = exits[g[:k], up] - (up != s[:k])
        points[:k] += e > 0
        total[:k] += e
        before = city(up, g[:k])
        away[:k] += left > before
        turn = (row[c] - row[up]) * 2 + col[c] - col[up]
        if step:
            bends[:k] += turn != move[:k]
        c, left, move = up, before, turn
    first = exits[g, s]
    branch = (first / 3 + (total - first) / 2) / n
    manhattan = city(s, g)
    length, detour = n / (n + LENGTH_SCALE), 1.0 - manhattan / n
    out = {
        "start_row": row[s], "start_col": col[s], "goal_row": row[g], "goal_col": col[g], "path_len": n, "manhattan": manhattan, "away_steps": away, "distractor_points": points, "distractor_exits": total,
        "branch_score": branch, "length_score": length, "detour_score": detour, "difficulty": W_LENGTH * length + W_BRANCH * branch + W_DETOUR * detour, "turns": bends,
    }
    back = np.argsort(order, kind="stable")
    return {k: v[back] for k, v in out.items()}


def pairs(cells: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All ordered reachable pairs of each map as in ``pair_records``; of its columns, those asked for."""
    types = {x.split()[0]: x for x in PAIR_SCHEMA.split(", ")}
    schema = [types[x] for x in (types if columns is None else columns)]
    names = [x.split()[0] for x in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, free in zip(b.column("map_id").to_pylist(), b.column("free").to_pylist(), strict=True):
                got = pair_arrays(Graph((c["row"], c["col"]) for c in free))
                got["map_id"] = np.full(len(got["path_len"]), m, np.int64)
                whole = pa.RecordBatch.from_arrays([pa.array(got[x]) for x in names], names=names)
                for lo in range(0, whole.num_rows, BATCH_ROWS):
                    yield whole.slice(lo, BATCH_ROWS)

    return _packed(cells).mapInArrow(run, ", ".join(schema))


def distances(cells: DataFrame) -> DataFrame:
    """(map_id, start, goal, d, parent) of all reachable pairs, parents in the order of the search."""

    def kernel(g: Graph, rows: int, cols: int) -> Iterator[dict]:
        for s in g.free:
            dist, parent = g.search(s)
            for t, d in dist.items():
                up = parent[t] or (-1, -1)
                yield {"start_row": s[0], "start_col": s[1], "row": t[0], "col": t[1], "d": d, "parent_row": up[0], "parent_col": up[1]}

    return _per_map(cells, kernel, "map_id long, start_row int, start_col int, row int, col int, d int, parent_row int, parent_col int")


def components(cells: DataFrame) -> DataFrame:
    """(map_id, row, col, component), the component named by its first cell in row order."""

    def kernel(g: Graph, rows: int, cols: int) -> Iterator[dict]:
        for found in g.components():
            name = min(found)
            for r, c in sorted(found):
                yield {"row": r, "col": c, "component": name[0] * cols + name[1]}

    return _per_map(cells, kernel, "map_id long, row int, col int, component int")


def static_difficulty(m: Mapping[str, float]) -> float:
    """Weighted, clamped parts of a map's structure, in per cent with two digits."""
    ratio = {
        "path": m["path_len"] / max(m["rows"] + m["cols"] - 4, 1),
        "turn": m["turns"] / max(m["path_len"], 1),
        "junction": m["solution_junctions"] / max(m["path_len"] + 1, 1),
        "articulation": m["articulation_points"] / max(m["free"], 1),
        "deadend": m["deadends"] / max(m["free"], 1),
        "bridge": m["bridges"] / max(m["edges"], 1),
        "wall": 1 - m["free"] / (m["rows"] * m["cols"]),
        "cycle": m["cycle_rank"] / max(m["free"], 1),
    }
    return round(100.0 * sum(w * max(0.0, min(ratio[k] / full, 1.0)) for k, (w, full) in STATIC_PARTS.items()), 2)


METRIC_SCHEMA = (
    "map_id long, rows int, cols int, free int, edges int, components int, diameter int, path_len int, turns int, solution_junctions int, deadends int, corridor_cells int, forks int, crosses int, "
    "cycle_rank int, articulation_points int, bridges int, corridors int, corridor_mean double, corridor_max int, static_difficulty double"
)


def metrics(graph: Graph, rows: int, cols: int, start: Cell | None = None, goal: Cell | None = None) -> dict:
    """The structure of one connected map; start and goal default to the ends of its diameter."""
    parts = graph.components()
    if len(parts) != 1:
        raise ValueError(f"the map has {len(parts)} components")
    diameter, a, b = graph.diameter()
    path = graph.path(graph.search(start or a)[1], goal or b)
    degree = {c: len(n) for c, n in graph.near.items()}
    points, bridges = graph.cuts()
    runs = graph.corridors()
    n_edges = sum(degree.values()) // 2
    m = {
        "rows": rows, "cols": cols, "free": len(graph.free), "edges": n_edges, "components": 1, "diameter": diameter, "path_len": len(path) - 1, "turns": turns(path),
        "solution_junctions": sum(degree[c] >= 3 for c in path), "deadends": sum(d == 1 for d in degree.values()), "corridor_cells": sum(d == 2 for d in degree.values()),
        "forks": sum(d == 3 for d in degree.values()), "crosses": sum(d >= 4 for d in degree.values()), "cycle_rank": n_edges - len(graph.free) + 1,
        "articulation_points": len(points), "bridges": len(bridges), "corridors": len(runs), "corridor_mean": sum(runs) / len(runs) if runs else 0.0, "corridor_max": max(runs, default=0),
    }
    return m | {"static_difficulty": static_difficulty(m)}


def map_metrics(cells: DataFrame) -> DataFrame:
    """Structure of the largest component of each map (ties to the first)."""

    def kernel(g: Graph, rows: int, cols: int) -> Iterator[dict]:
        if g.free:
            yield metrics(Graph(max(g.components(), key=lambda p: (len(p), [-x for x in min(p)]))), rows, cols)

    return _per_map(cells, kernel, METRIC_SCHEMA)


def diverse_cells(graph: Graph) -> list[Cell]:
    """Cells far from each other: from the diameter's ends on, the cell farthest from those chosen (ties to the first)."""
    want = 4 if len(graph.free) <= 30 else 8
    _, a, b = graph.diameter()
    chosen = [a] if a == b else [a, b]
    reach = [graph.search(c)[0] for c in chosen]
    while len(chosen) < min(want, len(graph.free)):
        left = [c for c in graph.free if c not in chosen and all(c in r for r in reach)]
        if not left:
            break
        nxt = max(left, key=lambda c: (min(r[c] for r in reach), (-c[0], -c[1])))
        chosen.append(nxt)
        reach.append(graph.search(nxt)[0])
    return chosen


def hard_pairs(pairs: DataFrame, alpha: float, top: int | None = None, longest: int | None = None) -> DataFrame:
    """The older difficulty (half relative length, half steps away), the length limit before the top n, ranks after both."""
    from stridelake.operators.ordered import rank_weights

    far = F.max("path_len").over(Window.partitionBy("map_id"))
    score = 0.5 * F.col("path_len") / F.col("far") + 0.5 * F.col("away_steps") / F.greatest(F.col("path_len"), F.lit(1))
    p = pairs.withColumn("far", far).withColumn("hard", score).drop("far")
    if longest is not None:
        p = p.filter(F.col("path_len") <= longest)
    order = ["hard", "path_len", "away_steps", "start_row", "start_col", "goal_row", "goal_col"]
    if top is not None:
        w = Window.partitionBy("map_id").orderBy(*(F.desc(c) for c in order))
        p = p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")
    return rank_weights(p, ["map_id"], order, alpha)


def map_difficulty(pairs: DataFrame) -> DataFrame:
    """Mean difficulty of a map's hardest tenth of pairs."""
    from stridelake.operators.ordered import top_fraction

    order = ["difficulty", "path_len", "distractor_exits", "away_steps", "start_row", "start_col", "goal_row", "goal_col"]
    w = Window.partitionBy("map_id")
    counted = pairs.withColumn("pairs", F.count(F.lit(1)).over(w)).withColumn("diameter", F.max("path_len").over(w))
    top = top_fraction(counted, ["map_id"], order, TOP_SHARE)
    return top.groupBy("map_id").agg(F.avg("difficulty").alias("map_difficulty"), F.count(F.lit(1)).alias("counted"), F.max("pairs").alias("pairs"), F.max("diameter").alias("diameter"))


def stable_number(*parts, bits: int = 64) -> int:
    """A number from the hash of the parts as compact JSON."""
    text = json.dumps(list(parts), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return int.from_bytes(hashlib.sha256(text.encode()).digest(), "big") % (1 << bits)


def perfect_maze(seed: int, spec: Mapping[str, int | str]) -> list[list[int]]:
    """A connected maze without cycles: walls between rooms fall in the order of their hashes unless both sides are joined.

    ``spec``: version, and rows and cols (odd, at least 5) or min_size and max_size (odd).
    """
    if "rows" in spec:
        rows, cols = int(spec["rows"]), int(spec["cols"])
    else:
        sizes = range(int(spec["min_size"]), int(spec["max_size"]) + 1, 2)
        rows = cols = sizes[stable_number(spec["version"], dict(spec), seed, "size") % len(sizes)]
    if rows % 2 == 0 or cols % 2 == 0 or min(rows, cols) < 5:
        raise ValueError("sizes are odd and at least 5")
    rooms = [(r, c) for r in range(1, rows, 2) for c in range(1, cols, 2)]
    walls = []
    for r, c in rooms:
        for n in ((r, c + 2), (r + 2, c)):
            if n[0] < rows - 1 and n[1] < cols - 1:
                walls.append((stable_number(spec["version"], dict(spec), seed, "edge", r, c, *n, bits=256), (r, c), n))
    grid = [[1] * cols for _ in range(rows)]
    group = {room: {room} for room in rooms}
    for r, c in rooms:
        grid[r][c] = 0
    for _, a, b in sorted(walls):
        if group[a] is not group[b]:
            small, large = sorted((group[a], group[b]), key=len)
            large |= small
            for room in small:
                group[room] = large
            grid[(a[0] + b[0]) // 2][(a[1] + b[1]) // 2] = 0
    return grid


def mazes(spark: SparkSession, seeds: DataFrame, spec: Mapping[str, int | str]) -> DataFrame:
    """(map_id, row, col, is_free) of the maze of every seed (a column map_id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(int(s), r, c, v == 0) for s in b["map_id"] for r, line in enumerate(perfect_maze(int(s), spec)) for c, v in enumerate(line)]
            yield pd.DataFrame(rows, columns=["map_id", "row", "col", "is_free"])

    return seeds.select("map_id").mapInPandas(run, "map_id long, row long, col long, is_free boolean")


def random_layout(seed: int, rows: int, cols: int, free_share: float, loop_share: float) -> list[list[int]]:
    """A spanning maze with some further walls opened until a share of cells is free, by seeded hashes, each beside a free cell; no open block of two by two arises."""
    grid = perfect_maze(seed, {"version": "layout", "rows": rows, "cols": cols})
    inner = [(r, c) for r in range(1, rows - 1) for c in range(1, cols - 1) if grid[r][c] == 1]
    free = sum(v == 0 for line in grid for v in line)
    for r, c in sorted(inner, key=lambda p: stable_number("open", seed, *p)):
        if free >= free_share * rows * cols:
            break
        sides = [grid[r - 1][c] == 0, grid[r + 1][c] == 0, grid[r][c - 1] == 0, grid[r][c + 1] == 0]
        if not any(sides):  # opened, it would be a part of its own
            continue
        ends = [sides[0] and sides[1], sides[2] and sides[3]]
        if not any(ends) and stable_number("pocket", seed, r, c) % 1000 >= 500 or any(ends) and stable_number("loop", seed, r, c) % 1000 >= 1000 * loop_share:
            continue
        blocks = [(r + a, c + b) for a in (-1, 0) for b in (-1, 0)]
        if any(all((y, x) == (r, c) or grid[y][x] == 0 for y in (p, p + 1) for x in (q, q + 1)) for p, q in blocks):
            continue
        grid[r][c] = 0
        free += 1
    return grid


def layout_penalties(seeds: DataFrame, rows: int, cols: int, free_share: float, loop_share: float, wanted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(seed, penalty): how far the metrics of each seed's layout lie outside the wanted ranges, in widths of these."""

    def penalty(seed: int) -> float:
        grid = random_layout(seed, rows, cols, free_share, loop_share)
        m = metrics(Graph((r, c) for r, line in enumerate(grid) for c, v in enumerate(line) if v == 0), rows, cols)
        return float(sum(max(lo - m[k], m[k] - hi, 0) / max(hi - lo, 1e-9) for k, (lo, hi) in wanted.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"seed": b["seed"].astype("int64"), "penalty": [penalty(int(s)) for s in b["seed"]]})

    return _spread(seeds.select(F.col("seed").cast("long").alias("seed")), "seed").mapInPandas(run, "seed long, penalty double")


def best_layouts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The seed of the least penalty, of each group if there are some; the smallest of equals."""
    return scored.groupBy(*by).agg(F.min(F.struct("penalty", "seed")).alias("b")).select(*by, "b.seed", "b.penalty")


def eval_pool(pairs: DataFrame, mode: str, seed: int, percent: float | None = None, n: int | None = None) -> DataFrame:
    """Start and goal pairs to evaluate on: 'all', or 'hard': the hardest share or number of each map, in a seeded order."""
    from stridelake.operators.sampling import hash_key

    w = Window.partitionBy("map_id")
    order = [F.desc(c) for c in ("difficulty", "path_len", "distractor_exits", "away_steps", "start_row", "start_col", "goal_row", "goal_col")]
    if mode == "hard":
        share = (percent / 100 if percent and percent > 1 else percent) or 0.0
        size = F.lit(n) if n is not None else F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.lit(1)).over(w) * share))
        pairs = pairs.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", size).filter("_r <= _n").drop("_r", "_n")
    elif mode != "all":
        raise ValueError(f"unknown mode: {mode}")
    name = [F.col(c) for c in ("map_id", "start_row", "start_col", "goal_row", "goal_col")]
    return pairs.withColumn("position", F.row_number().over(w.orderBy(hash_key(seed, *name), *order)) - 1)


def label_components(cells: DataFrame, rounds: int) -> DataFrame:
    """Components by spreading the least cell number; ``rounds`` is at least the longest distance in a map.

    The relational twin of the search, for maps that are bounded in size.
    """
    e = edges(cells).select("map_id", (F.col("row") * 1000 + F.col("col")).alias("a"), (F.col("nrow") * 1000 + F.col("ncol")).alias("b"))
    near = e.groupBy("map_id", "a").agg(F.collect_list("b").alias("near"))
    f = free_cells(cells).select("map_id", (F.col("row") * 1000 + F.col("col")).alias("a")).join(near, ["map_id", "a"], "left")
    whole = f.groupBy("map_id").agg(F.map_from_entries(F.collect_list(F.struct("a", F.coalesce("near", F.array().cast("array<bigint>"))))).alias("g"))
    label: Column = F.map_from_entries(F.transform(F.map_keys("g"), lambda k: F.struct(k, k)))
    spread = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), label, lambda m, _: F.transform_values(m, lambda k, v: F.least(v, F.coalesce(F.array_min(F.transform(F.col("g")[k], lambda x: m[x])), v))))
    return whole.select("map_id", F.explode(spread).alias("a", "component")).select("map_id", F.floor(F.col("a") / 1000).alias("row"), (F.col("a") % 1000).alias("col"), "component")
