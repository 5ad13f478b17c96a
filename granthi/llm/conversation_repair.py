"""Cheapest edits that give each conversation the order (system)? (user assistant)+, by an auction on a lattice.

A lattice has one layer for each gap between rows and four states in each: nothing yet, after a system, user or assistant
turn. Its arcs are the edits (keep, rerole, delete a row: to the next layer; insert a turn: inside a layer), with integer
costs. The auction keeps a price for every node and one path from the origin. At the end of the path
it either raises the node's price to the least of cost and price over the arcs (and takes the last arc back),
or it extends the path by the arc that attains it, until the path reaches the target. Prices begin with what rows
cost at least (deleting a blank or repeated one), a feasible potential. The final prices are an optimal dual, so that all
cheapest paths consist of tight arcs; the least string in ASCII order is traced along tight arcs that lead to the target.

1. Rows that agree in conversation, turn, role and text are merged with their number, which bounds no group but makes
   mere repetition cheap; all but the first are duplicates and must go.
2. Rows are sorted by (conversation, turn, role, text) in ranges, so a long conversation lies in several tasks. A conversation
   inside one task is solved there. A piece at the edge of a task is solved for each pair of entry and exit state.
3. The pieces of a conversation (one per task) are chained by their costs and the order of their strings.
   Within a task, more than ``BLOCK`` rows are cut and chained alike: the auction's steps grow with the square of a block.

Rows of one turn are taken by role and text. Null conversation ids form one conversation; null turns come first; a null role
or text is one blank. A role without a character can't be kept, only reroled or deleted. Texts are never cut. Columns other
than the four named are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthi.llm.common import give_back, whole_groups
from granthi.session import materialise

BLOCK = 32
LANES = 2048  # lattices that are solved side by side

DELETE, INSERT, KEEP, REROLE = range(4)  # in ASCII order
LETTERS = np.frombuffer(b"DIKR", np.uint8)
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED = 5
FAR = 1 << 40

NEXT = np.array([2, 2, 3, 2])  # state after the turn that is due
ROLE = {2: "user", 3: "assistant"}
INITIAL = {"s": 1, "u": 2, "a": 3}
KEEPS = np.full((4, 4), -1)  # state and initial -> state
KEEPS[0, 1], KEEPS[0, 2], KEEPS[1, 2], KEEPS[2, 3], KEEPS[3, 2] = 1, 2, 2, 3, 2
ACCEPTS = np.array([True, False, False, True])
LEGAL = {"su", "ua", "au"}

# A chained part: costs from entry to exit state, and the edits.
Part = tuple[np.ndarray, list[list[str | None]]]
END: Part = (np.array([[0, FAR, FAR, FAR], [10, FAR, FAR, FAR], [5, FAR, FAR, FAR], [0, FAR, FAR, FAR]]),
             [["", None, None, None], ["II", None, None, None], ["I", None, None, None], ["", None, None, None]])


class Lattices:
    """Lattices of equal height, one lane each. Row columns: initial, forced, truncated, extra; -1 as initial: the end."""

    def __init__(self, initial: np.ndarray, forced: np.ndarray, truncated: np.ndarray, extra: np.ndarray, rows: np.ndarray,
                 exits: np.ndarray) -> None:
        lanes, height = initial.shape
        self.rows, self.height = rows, height
        state = np.arange(4)
        base = 2 * extra[:, :, None] + np.zeros(4, np.int64)
        real = (np.arange(height) < rows[:, None])
        end = (initial == -1) & real
        open_ = (real & ~end & ~forced)[:, :, None]
        late = TRUNCATED * truncated[:, :, None]
        kept = KEEPS[state[None, None, :], np.maximum(initial, 0)[:, :, None]]
        cost = np.full((lanes, height + 1, 4, 4), FAR, np.int64)
        to = np.zeros((lanes, height + 1, 4, 4), np.int64)
        below = 4 * (np.arange(height) + 1)[None, :, None]
        cost[:, :-1, :, DELETE] = np.where((real & ~end)[:, :, None], base + COST[DELETE], np.where(end[:, :, None] & ACCEPTS, 0, FAR))
        to[:, :-1, :, DELETE] = below + np.where(end[:, :, None], 0, state)
        cost[:, :-1, :, KEEP] = np.where(open_ & (kept >= 0), base + COST[KEEP] + late, FAR)
        to[:, :-1, :, KEEP] = below + np.maximum(kept, 0)
        cost[:, :-1, :, REROLE] = np.where(open_, base + COST[REROLE] + late, FAR)
        to[:, :-1, :, REROLE] = below + NEXT
        cost[:, :-1, :, INSERT] = np.where(real[:, :, None], COST[INSERT], FAR)
        to[:, :, :, INSERT] = 4 * np.arange(height + 1)[None, :, None] + NEXT
        self.cost, self.to = cost.reshape(lanes, -1, 4), to.reshape(lanes, -1, 4)
        self.target = 4 * rows + exits
        leads = self._lead(self.cost < FAR)
        # What the rows from each layer on cost at least.
        least = np.where(real & ~end, 2 * extra + np.where(forced | truncated, 2, 0), 0)
        rest = np.zeros((lanes, height + 1), np.int64)
        rest[:, :-1] = np.cumsum(least[:, ::-1], axis=1)[:, ::-1]
        self.price = np.where(leads, np.repeat(rest, 4, axis=1), FAR)

    def _lead(self, usable: np.ndarray) -> np.ndarray:
        """Nodes from which the target is reached along usable arcs."""
        lanes = np.arange(len(self.rows))
        leads = np.zeros(self.cost.shape[:2], bool)
        leads[lanes, self.target] = True
        for layer in range(self.height, -1, -1):
            at = slice(4 * layer, 4 * layer + 4)
            down = usable[:, at] & (self.to[:, at] >= 4 * layer + 4)
            for a in (DELETE, KEEP, REROLE):
                leads[:, at] |= down[:, :, a] & leads[lanes[:, None], self.to[:, at, a]]
            for _ in range(2):
                leads[:, at] |= usable[:, at, INSERT] & leads[lanes[:, None], self.to[:, at, INSERT]]
        return leads

    def auction(self, entry: int) -> None:
        """Raise prices until the path from ``entry`` reaches the target in every lane where one exists."""
        lane = np.flatnonzero(self.price[:, entry] < FAR)
        path = np.zeros((len(self.rows), 4 * self.height + 8), np.int64)
        path[:, 0], depth = entry, np.zeros(len(self.rows), np.int64)
        while len(lane):
            at = path[lane, depth[lane]]
            bids = self.cost[lane, at] + self.price[lane[:, None], self.to[lane, at]]
            best = bids.argmin(axis=1)
            least = bids[np.arange(len(lane)), best]
            shorter = self.price[lane, at] < least
            back, on = lane[shorter], lane[~shorter]
            self.price[back, at[shorter]] = least[shorter]
            depth[back] = np.maximum(depth[back] - 1, 0)
            depth[on] += 1
            path[on, depth[on]] = self.to[on, at[~shorter], best[~shorter]]
            lane = lane[path[lane, depth[lane]] != self.target[lane]]

    def trace(self, entry: int) -> tuple[np.ndarray, list[str]]:
        """(costs, least string of edits without those of the end; ``extra`` deletions are left to the caller)."""
        lanes = np.arange(len(self.rows))
        there = self.price[:, entry] < FAR
        tight = (self.price[:, :, None] == self.cost + self.price[lanes[:, None, None], self.to]) & (self.cost < FAR)
        leads = self._lead(tight)
        at, letters, lengths = np.full(len(lanes), entry), [], np.zeros(len(lanes), np.int64)
        while True:
            going = there & (at != self.target)
            if not going.any():
                break
            good = tight[lanes, at] & leads[lanes[:, None], self.to[lanes, at]]
            first = good.argmax(axis=1)
            letters.append(np.where(going, LETTERS[first], 0))
            lengths += going
            at = np.where(going, self.to[lanes, at, first], at)
        out = np.stack(letters, axis=1) if letters else np.zeros((len(lanes), 0), np.uint8)
        costs = np.where(there, self.price[:, entry] - self.price[lanes, self.target], FAR)
        return costs, [row[:n].tobytes().decode() for row, n in zip(out.astype(np.uint8), lengths)]


def with_extra(edits: str, extra: np.ndarray) -> str:
    """Deletions of the merged copies behind the edit of their row."""
    if not extra.any():
        return edits
    out, row = [], 0
    for letter in edits:
        out.append(letter)
        if letter != "I":
            out.append("D" * int(extra[row]))
            row += 1
    return "".join(out)


def solve(columns: np.ndarray, begins: np.ndarray, ends: np.ndarray, final: bool) -> list[tuple[int, str]] | list[Part]:
    """Rows [begin, end) by (initial, forced, truncated, extra): (cost, edits) of whole conversations, or a part for each span."""
    out: list = []
    sizes = ends - begins + final
    order = np.argsort(sizes, kind="stable")
    found: dict[int, object] = {}
    many = 1 if final else 4
    for a in range(0, len(order), LANES // many):
        spans = order[a: a + LANES // many]
        height = int(sizes[spans].max())
        table = np.zeros((len(spans), height, 4), np.int64)
        for i, s in enumerate(spans):
            table[i, : ends[s] - begins[s]] = columns[begins[s]: ends[s]]
            if final:
                table[i, ends[s] - begins[s], 0] = -1
        lanes = np.repeat(table, many, axis=0)
        exits = np.tile(np.arange(many), len(spans))
        lattices = Lattices(lanes[:, :, 0], lanes[:, :, 1] > 0, lanes[:, :, 2] > 0, lanes[:, :, 3], np.repeat(sizes[spans], many), exits)
        entries = range(many)
        for e in entries:
            lattices.auction(e)
        traced = [lattices.trace(e) for e in entries]
        for i, s in enumerate(spans):
            extra = columns[begins[s]: ends[s], 3]
            if final:
                cost, edits = int(traced[0][0][i]), traced[0][1][i][:-1]  # without the arc of the end
                found[s] = (cost, with_extra(edits, extra))
            else:
                costs = np.stack([traced[e][0][4 * i: 4 * i + 4] for e in entries])
                texts = [[with_extra(traced[e][1][4 * i + x], extra) if costs[e, x] < FAR else None for x in range(4)] for e in entries]
                found[s] = (costs, texts)
    out.extend(found[s] for s in range(len(begins)))
    return out


def chain(costs: list[np.ndarray], ranks: list[np.ndarray], exit_: int) -> tuple[np.ndarray, list[list[int]]]:
    """For each entry state the least cost to ``exit_`` over all parts in turn, and the exit states along the least strings."""
    rest = [np.where(np.arange(4) == exit_, 0, FAR)]
    for c in reversed(costs):
        rest.append(np.minimum((c + rest[-1][None, :]).min(axis=1), FAR))
    rest.reverse()
    ways: list[list[int]] = []
    for entry in range(4):
        way, at = [], entry
        if rest[0][entry] < FAR:
            for k, c in enumerate(costs):
                good = np.flatnonzero((c[at] + rest[k + 1] == rest[k][at]) & (c[at] < FAR) & (rest[k + 1] < FAR))
                at = int(good[np.argmin(ranks[k][at][good])])
                way.append(at)
        ways.append(way)
    return rest[0], ways


def ranked(texts: list[list[str | None]]) -> np.ndarray:
    """Order of the strings to the four exits, for each entry. None of them begins another: all end with a row's edit."""
    out = np.full((4, 4), 4)
    for e, row in enumerate(texts):
        for place, x in enumerate(sorted((x for x in range(4) if row[x] is not None), key=lambda x: row[x])):
            out[e, x] = place
    return out


def joined(parts: list[Part]) -> Part:
    if len(parts) == 1:
        return parts[0]
    costs, ranks = [c for c, _ in parts], [ranked(t) for _, t in parts]
    total, texts = np.full((4, 4), FAR), [[None] * 4 for _ in range(4)]
    for x in range(4):
        least, ways = chain(costs, ranks, x)
        total[:, x] = least
        for e in range(4):
            if least[e] < FAR:
                texts[e][x] = "".join(parts[k][1][a][b] for k, (a, b) in enumerate(zip([e, *ways[e][:-1]], ways[e])))
    return total, texts


def repaired(edits: str, state: int, roles: list[str], texts: list[str], copies: np.ndarray) -> list[str]:
    """Lines of the turns that remain, for the edits of these rows from ``state`` on."""
    lines, row, left = [], 0, 0
    for letter in edits:
        if letter == "I":
            state = int(NEXT[state])
            lines.append(f"{ROLE[state]}:")
            continue
        if not left:
            left = int(copies[row])
        if letter == "K":
            state = int(KEEPS[state, INITIAL[roles[row][0]]])
            lines.append(f"{roles[row]}:{texts[row]}")
        elif letter == "R":
            state = int(NEXT[state])
            lines.append(f"{ROLE[state]}:{texts[row]}")
        left -= 1
        row += not left
    return lines


RESULT = ("no_id int, conv_id long, piece int, cost long, illegal long, audit string, repaired_sha256 string, costs array<long>, "
          "ranks array<long>, audits array<string>, roles array<string>, texts array<string>, copies array<long>")


def _solve_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations inside the task as results, those at its edges as pieces."""
    piece = TaskContext.get().partitionId()
    schema = pa.schema([("no_id", pa.int32()), ("conv_id", pa.int64()), ("piece", pa.int32()), ("cost", pa.int64()),
                        ("illegal", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("costs", pa.list_(pa.int64())),
                        ("ranks", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())),
                        ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64()))])

    def solved(rows: pa.Table, starts: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        ends = np.append(starts[1:], rows.num_rows)
        roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        copies = np.asarray(rows.column("copies").combine_chunks())
        firsts = [r[:1] for r in roles]
        forced = np.asarray(rows.column("forced").combine_chunks())
        columns = np.stack([np.array([INITIAL.get(c, 0) for c in firsts]), forced,
                            np.asarray(rows.column("truncated").combine_chunks()), copies - 1], axis=1).astype(np.int64)
        edge = np.zeros(len(starts), bool)
        edge[0] |= first
        edge[-1] |= last
        small = np.flatnonzero(~edge & (ends - starts <= BLOCK))
        whole = dict(zip(small.tolist(), solve(columns, starts[small], ends[small], True)))
        cut = {g: np.arange(starts[g], ends[g], BLOCK) for g in range(len(starts)) if g not in whole}
        begins = np.concatenate([*cut.values(), np.zeros(0, np.int64)]).astype(np.int64)
        stops = np.concatenate([*(np.append(c[1:], ends[g]) for g, c in cut.items()), np.zeros(0, np.int64)]).astype(np.int64)
        parts = iter(solve(columns, begins, stops, False))
        out = []
        ids = list(zip(rows.column("no_id").to_pylist(), rows.column("conv_id").to_pylist()))
        for g, (a, b) in enumerate(zip(starts, ends)):
            broken = int((copies[a:b] - 1).sum()) + sum(x + y not in LEGAL for x, y in zip(firsts[a: b - 1], firsts[a + 1: b]))
            row = {"no_id": ids[a][0], "conv_id": ids[a][1], "illegal": broken}
            if g in whole:
                cost, audit = whole[g]
            else:
                own = [next(parts) for _ in cut[g]]
                if edge[g]:
                    costs, edits = joined(own)
                    out.append(row | {"piece": piece, "costs": costs.ravel().tolist(), "ranks": ranked(edits).ravel().tolist(),
                                      "audits": [t for r in edits for t in r], "roles": roles[a:b], "texts": texts[a:b],
                                      "copies": copies[a:b].tolist()})
                    continue
                costs, edits = joined([*own, END])
                cost, audit = int(costs[0, 0]), edits[0][0]
            lines = repaired(audit, 0, roles[a:b], texts[a:b], copies[a:b])
            out.append(row | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()})
        return pa.RecordBatch.from_pylist(out, schema)

    held, first = None, True
    for rows, starts in whole_groups(batches, ["no_id", "conv_id"]):
        if held is not None:
            yield solved(*held, first, False)
            first = False
        held = rows, starts
    if held is not None:
        yield solved(*held, first, True)
    give_back()


WAY = "no_id int, conv_id long, piece int, entry int, leaves int, total long, broken long, last boolean"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States by which the pieces of each conversation are passed. Holds costs only: a row per piece, a piece per task."""
    for rows, starts in whole_groups(batches, ["no_id", "conv_id"]):
        table, out = rows.to_pydict(), []
        for a, b in zip(starts, [*starts[1:], rows.num_rows]):
            costs = [np.array(c, np.int64).reshape(4, 4) for c in table["costs"][a:b]]
            ranks = [np.array(r, np.int64).reshape(4, 4) for r in table["ranks"][a:b]]
            least, ways = chain([*costs, END[0]], [*ranks, ranked(END[1])], 0)
            seams = sum(x + y not in LEGAL for x, y in zip(table["last_initial"][a: b - 1], table["first_initial"][a + 1: b]))
            broken = sum(table["illegal"][a:b]) + seams
            for k, i in enumerate(range(a, b)):
                out.append((table["no_id"][i], table["conv_id"][i], table["piece"][i], 0 if k == 0 else ways[0][k - 1], ways[0][k],
                            int(least[0]), broken, i == b - 1))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        names = [part.split()[0] for part in WAY.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    give_back()


SPELLED = "no_id int, conv_id long, cost long, illegal long, audit string, repaired_sha256 string"


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and digest of each chained conversation, one piece in memory at a time."""
    audit, digest, begun = [], hashlib.sha256(), False
    for batch in batches:
        for row in batch.to_pylist():
            edits = row["audits"][4 * row["entry"] + row["leaves"]]
            if row["last"]:
                edits += END[1][row["leaves"]][0]
            audit.append(edits)
            for line in repaired(edits, row["entry"], row["roles"], row["texts"], np.array(row["copies"])):
                digest.update(("\n" if begun else "").encode() + line.encode())
                begun = True
            if row["last"]:
                yield pa.RecordBatch.from_pylist([{
                    "no_id": row["no_id"], "conv_id": row["conv_id"], "cost": row["total"], "illegal": row["broken"],
                    "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], pa.schema([
                        ("no_id", pa.int32()), ("conv_id", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()),
                        ("audit", pa.string()), ("repaired_sha256", pa.string())]))
                audit, digest, begun = [], hashlib.sha256(), False
    give_back()


def damaged(turns: DataFrame) -> DataFrame:
    """(no_id, conv_id, turn, role, text, copies): rows with the damage that their ids choose."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))), F.lit(20))
    rows = turns.select(F.col("conv_id").isNull().cast("int").alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"),
                        F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    return rows.filter("kind <> 0").select(
        "no_id", "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns per conversation of ``rows`` (as from ``damaged``)."""
    key = ["no_id", "conv_id"]
    # A null turn comes first: order by (is there a turn, turn).
    merged = rows.groupBy(*key, "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    merged = materialise(merged.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    first = merged.groupBy(*key, "role", "text").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    judged = (
        merged.join(first, [*key, "role", "text"], "left")
        .withColumn("seen", F.coalesce(order != F.col("first"), F.lit(False)))
        .withColumn("open", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    )
    judged = materialise(judged.select(
        *key, "turn", "role", "text", "copies", "blank", (F.col("blank") | F.col("seen")).cast("int").alias("forced"),
        (~F.col("blank") & ~F.col("seen") & F.col("open")).cast("int").alias("truncated")), "judged")
    whole = F.when(F.col("forced") == 1, F.col("copies")).otherwise(F.col("copies") - 1)
    counts = judged.groupBy(*key, "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(whole)).alias("duplicate"), F.sum("truncated").alias("truncated"),
    ).groupBy(*key).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"))
    by_turn = [*key, F.col("turn").asc_nulls_first(), "role", "text"]
    solved = materialise(
        judged.repartitionByRange(*by_turn).sortWithinPartitions(*by_turn)
        .select(*key, "role", "text", "copies", "forced", "truncated").mapInArrow(_solve_sorted, RESULT), "solved")
    pieces = solved.filter("piece IS NOT NULL")
    initial = lambda place: F.substring(F.element_at("roles", place), 1, 1)
    ways = materialise(
        pieces.select(*key, "piece", "costs", "ranks", "illegal", initial(1).alias("first_initial"), initial(-1).alias("last_initial"))
        .repartition(*key).sortWithinPartitions(*key, "piece").mapInArrow(_chained, WAY), "ways")
    spelled = (
        pieces.select(*key, "piece", "audits", "roles", "texts", "copies").join(ways, [*key, "piece"])
        .repartition(*key).sortWithinPartitions(*key, "piece").mapInArrow(_spelled, SPELLED))
    done = solved.filter("piece IS NULL").select(*key, "cost", "illegal", "audit", "repaired_sha256").unionByName(spelled)
    return done.join(counts, key)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of ``turns``."""
    key = ["no_id", "conv_id"]
    named = turns.select(F.col("conv_id").isNull().cast("int").alias("no_id"),
                         F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id")).distinct()
    done = named.join(repair(damaged(turns)), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return done.select(
        F.when(F.col("no_id") == 0, F.col("conv_id")).alias("conv_id"),
        *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
