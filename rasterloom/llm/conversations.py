"""Repair of the turn structure of conversations at the least cost of edits.

A sound conversation is an optional system row and then pairs of a user's and an assistant's row, or
nothing. Edits of a row: keep it (cost 0), give it the role user or assistant (2), delete it (3; blank
rows and repeats of earlier rows must go); anywhere an empty row of user or assistant can be put in (2).
A row that stays though its text breaks off costs 1 more.

States of the structure times places between rows are the nodes of a DAG, edits its arcs. Least costs
from the start (forward) and to the end (backward) tell which arcs are tight: those on some cheapest path.
From the start, the tight arc of the least letter is taken at each step. A letter leads from a state to
one state only, so the frontier of the least sequence so far is always one state.

Rows are sorted by ranges of (conversation, turn), so one conversation may lie in many partitions.
Conversations inside one partition are repaired there. Of others (the first and last of a partition, and
long ones) each partition makes pieces of bounded size, whose costs from state to state are small
matrices: products of these bring the costs to each piece's borders, and pieces are repaired side by side.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import NOT_SPACE, shards_for, tidy, work_path, written

#: States: nothing yet, after the system's row, after a user's, after an assistant's.
STATES = 4
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an edit can give in each state, and the state after it.
GIVEN = ["u", "u", "a", "u"]
AFTER = [2, 2, 3, 2]
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 40
#: Costs to the end from each state behind the last row: only nothing and whole pairs are sound.
TO_END = (0, 2 * INSERT, INSERT, 0)
FROM_START = (0, NEVER, NEVER, NEVER)
#: Code points (with 100 for each row) of a piece of a conversation that isn't repaired as a whole; rows that cross to Python together.
PIECE, ROWS = 1_000_000, 500
BLANK, REPEAT, CUT = 1, 2, 3
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _arcs(symbol: str, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of a row's edits in a state, by letter. A symbol is the role's initial (o: another),
    a capital if the text breaks off; x: the row must go."""
    found = [("D", DELETE, q)]
    if symbol != "x":
        more = BROKEN * symbol.isupper()
        if (q, symbol.lower()) in NEXT:
            found.append(("K", KEEP + more, NEXT[q, symbol.lower()]))
        found.append(("R", REROLE + more, AFTER[q]))
    return found


ARCS = {s: [_arcs(s, q) for q in range(STATES)] for s in "suaoSUAOx"}


def _with_inserts(v: list[int]) -> tuple[int, ...]:
    """Costs to the end at a place, if rows may be put in there first."""
    two, three = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + two), min(v[1], INSERT + two), two, three


def backward(symbols: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least costs to the end from each state, at each place; end: those behind the last row."""
    found = [end]
    for s in reversed(symbols):
        after = found[-1]
        found.append(_with_inserts([min(c + after[to] for _, c, to in arcs) for arcs in ARCS[s]]))
    return found[::-1]


def forward(symbols: str, start: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least costs from the start to each state, at each place with what is put in there."""

    def put_in(v):
        two = min(v[2], INSERT + min(v[0], v[1], v[3]))
        return v[0], v[1], two, min(v[3], INSERT + two)

    found = [put_in(start)]
    for s in symbols:
        reached = [NEVER] * STATES
        for q, arcs in enumerate(ARCS[s]):
            for _, c, to in arcs:
                reached[to] = min(reached[to], found[-1][q] + c)
        found.append(put_in(reached))
    return found


def crossing(symbols: str) -> list[int]:
    """Least costs from each state before the rows to each state behind them, before anything is put in there."""
    by_end = [backward(symbols, tuple(0 if q == e else NEVER for q in range(STATES)))[0] for e in range(STATES)]
    return [min(NEVER, by_end[e][q]) for q in range(STATES) for e in range(STATES)]


def cheapest(symbols: str, start: tuple[int, ...], end: tuple[int, ...], state: int, last: bool) -> tuple[str, str, int]:
    """(letters, the role that each gives or -, the state behind) of the least cheapest edits from a state on."""
    fore, back = forward(symbols, start), backward(symbols, end)
    total = fore[0][state] + back[0][state]
    letters, given, i, q = [], [], 0, state
    while True:
        here, ahead = fore[i][q], back[i]
        if i < len(symbols):
            steps = [(letter, to, i + 1) for letter, c, to in ARCS[symbols[i]][q] if here + c + back[i + 1][to] == total]
        elif last and q in (1, 2):
            steps = []
        else:
            return "".join(letters), "".join(given), q
        if (i < len(symbols) or last) and here + INSERT + ahead[AFTER[q]] == total:
            steps.append(("I", AFTER[q], i))
        letter, to, i = min(steps)
        letters.append(letter)
        given.append(GIVEN[q] if letter in "IR" else "-")
        q = to


@lru_cache(maxsize=20_000)
def _solved(symbols: str) -> tuple[int, str, str]:
    letters, given, _ = cheapest(symbols, FROM_START, TO_END, 0, True)
    return backward(symbols, TO_END)[0][0], letters, given


def solve(symbols: str) -> tuple[int, str, str]:
    """(least cost, letters, given roles) of a whole conversation. Short ones are remembered; it only saves time."""
    return _solved(symbols) if len(symbols) <= 24 else _solved.__wrapped__(symbols)


def edited(letters: str, given: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired rows."""
    out, k = ([], []), 0
    for letter, g in zip(letters, given):
        if letter != "D":
            out[0].append(roles[k] if letter == "K" else ROLES[g])
            out[1].append("" if letter == "I" else texts[k])
        k += letter != "I"
    return out


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def symbols_of(initials: str, faults: list[int]) -> str:
    return "".join("x" if f in (BLANK, REPEAT) else i.upper() if f == CUT else i for i, f in zip(initials, faults))


def _turns(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """(least, largest, number of distinct) of turns that aren't null."""
    known = {t for t in turns if t is not None}
    return (min(known), max(known), len(known)) if known else (None, None, 0)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of rows with faults put in, by the remainder of the CRC of ``conv_id:turn`` by 20:
    0 drops the row (it stays with gone set, so that its conversation is known), 1 empties its text, 2 takes out
    ``. ! ?``, 3 repeats it, 4 makes it the user's. A null role or text, or part of the key, is one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    df = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


_PIECES = "conv_id {}, piece long, turns array<long>, roles array<string>, texts array<string>, hashes array<binary>, faults array<int>, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def _in_partition(names: list[str]):
    """Rows (conv_id, turn, role, text, gone, fault) of a sorted partition to repaired conversations, and pieces of others."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh3_128_digest

        first_piece, kinds = TaskContext.get().partitionId() << 32, None
        out: list[tuple] = []
        none = object()
        conv, rows, seen, size, pieces, begun, held = none, [], set(), 0, 0, 0, 0

        def piece():
            """The rows so far as a piece; repeats within it are marked, and others have their hash."""
            nonlocal rows, seen, size, pieces, held
            faults, hashes = [], []
            for _, role, text, fault in rows:
                key = xxh3_128_digest(f"{len(role)}:{role}{text}")
                faults.append(fault if fault == BLANK else REPEAT if key in seen else fault)
                hashes.append(key if faults[-1] not in (BLANK, REPEAT) else None)
                seen.add(key)
            turns, roles, texts = [list(c) for c in zip(*[r[:3] for r in rows])] if rows else ([], [], [])
            out.append((conv, first_piece + pieces, turns, roles, texts, hashes, faults, *[None] * 7))
            held += size
            rows, seen, size, pieces = [], set(), 0, pieces + 1

        def whole():
            nonlocal rows, size, held
            known, faults = set(), []
            for _, role, text, fault in rows:
                faults.append(fault if fault == BLANK else REPEAT if (role, text) in known else fault)
                known.add((role, text))
            initials = "".join(initial(r[1]) for r in rows)
            cost, letters, given = solve(symbols_of(initials, faults))
            low, high, distinct = _turns([r[0] for r in rows])
            roles, texts = edited(letters, given, [r[1] for r in rows], [r[2] for r in rows])
            counts = [0 if low is None else high - low + 1 - distinct, *[faults.count(f) for f in (BLANK, REPEAT, CUT)], illegal(initials), cost]
            out.append((conv, None, None, roles, texts, None, None, *counts, letters))
            held += size
            rows, size = [], 0

        def flush():
            nonlocal out, held
            done, out, held = out, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int32()), *[pa.int64()] * 6, pa.string()]
            for at in range(0, batch.num_rows, ROWS):
                for c, turn, role, text, gone, fault in zip(*[col.to_pylist() for col in batch.slice(at, ROWS).columns]):
                    if c != conv or conv is none:
                        if conv is not none:
                            # The first conversation may have begun in the partition before.
                            (piece if begun == 1 or pieces > opened else whole)()
                        conv, begun, opened = c, begun + 1, pieces
                    if not gone:
                        rows.append((turn, role, text, fault))
                        size += len(text) + 100
                        if size > PIECE:
                            piece()
                    if held > PIECE:
                        yield flush()
        if conv is not none:
            piece()
            yield flush()
        tidy()

    return run


def _by_piece(df: DataFrame, schema: str, make):
    """make(row) for each row (a dict) of df, as rows of schema; None is left out."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = [r for r in map(make, batch.slice(at, 16).to_pylist()) if r is not None]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow(schema, batch))

    return df.mapInArrow(run, schema)


def _arrow(schema: str, batch):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    own = {f.name: f.type for f in batch.schema}
    return pa.schema([(n, own[n] if n == "conv_id" else kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def _along(df: DataFrame, schema: str, start, step, backwards: bool = False):
    """step(state, row, whether the conversation begins, whether it ends) -> (state, row of schema), over each conversation's
    pieces in order, whose state is all that is kept. One task has all pieces' rows of a conversation, not their texts."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        held, begins, state, kinds, out = None, True, None, None, []

        def take(row, ends):
            nonlocal state, begins
            state, made = step(start if begins else state, row, begins, ends)
            begins = ends
            return dict(zip(names, made))

        for batch in batches:
            kinds = kinds or _arrow(schema, batch)
            for at in range(0, batch.num_rows, 200):
                for row in batch.slice(at, 200).to_pylist():
                    if held is not None:
                        out.append(take(held, held["conv_id"] != row["conv_id"]))
                    held = row
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([take(held, True)], schema=kinds)

    piece = F.col("piece").desc() if backwards else F.col("piece")
    return df.repartition("conv_id").sortWithinPartitions("conv_id", piece).mapInArrow(run, schema)


def _fault() -> Column:
    """0, BLANK or CUT of a text on its own."""
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    return F.when(~F.col("text").rlike(NOT_SPACE), BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0)


def repair(rows: DataFrame, shard_mb: float = 8) -> DataFrame:
    """Repaired conversations: conv_id, piece, roles and texts of its repaired rows in order, audit (a letter for each edit)
    and, on each conversation's last piece (last), the counts gaps, blank, duplicate, truncated, illegal and cost of the
    whole conversation. Most conversations are one piece; pieces of others follow one another by number.

    rows: conv_id, turn, role, text, and gone (rows that only name their conversation; a conversation without other
    rows is repaired to nothing at no cost). Rows go by turn, nulls first; those of equal turn by role and the
    text's hash. A null role or text is one space; a null conv_id is a conversation like any other. A role that
    begins with no s, u or a (or is empty) fits nowhere as it is. Equal rows are repeats of the first; an empty table
    gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    df = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text"), "gone")
    kind = df.schema["conv_id"].dataType.simpleString()
    parts = shards_for(rows, shard_mb)
    order = ["conv_id", "turn", "role", "tie", "spread"]
    df = df.select("*", _fault().alias("fault"), F.unhex(F.md5("text")).alias("tie"), F.monotonically_increasing_id().alias("spread"))
    df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "fault")
    schema = _PIECES.format(kind)
    done = written(df.mapInArrow(_in_partition([f.split()[0] for f in schema.split(", ")]), schema), "conversations")
    counts = [F.col(c) for c in COUNTS]
    inside = done.where("piece is null").select("conv_id", F.lit(0).cast("long").alias("piece"), "roles", "texts", "audit", F.lit(True).alias("last"), *counts)
    return inside.unionByName(_across(done.where("piece is not null"), kind, work_path(spark, "conversation-pieces")))


def _across(pieces: DataFrame, kind: str, path: str) -> DataFrame:
    """The repaired pieces of conversations that lie in more than one place."""
    spark = pieces.sparkSession
    # Repeats of a row of an earlier piece: a piece tells each row once, so a key has as many rows as pieces at most.
    told = pieces.select("conv_id", "piece", F.posexplode("hashes").alias("at", "hash")).where("hash is not null")
    first = told.groupBy("conv_id", "hash").agg(F.min("piece").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("whose"), F.col("hash").alias("what"), "first")
    later = told.join(first, F.col("conv_id").eqNullSafe(F.col("whose")) & (F.col("hash") == F.col("what"))).where("piece > first")
    later = later.groupBy("piece").agg(F.collect_list("at").alias("later"))
    # From here on a row of a piece is a letter.
    light = pieces.select("conv_id", "piece", "turns", "faults", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials")).join(later, "piece", "left")

    def summary(r):
        faults, initials = list(r["faults"]), "".join(map(initial, r["initials"]))
        for at in r["later"] or ():
            faults[at] = REPEAT
        symbols = symbols_of(initials, faults)
        numbers = [faults.count(f) for f in (BLANK, REPEAT, CUT)]
        return (r["conv_id"], r["piece"], symbols, initials[:1], initials[-1:], illegal(initials), *_turns(r["turns"]), numbers, crossing(symbols))

    fields = f"conv_id {kind}, piece long, symbols string, head string, tail string, illegal long, low long, high long, distinct long, numbers array<long>, costs array<long>"
    light = written(_by_piece(light.select("conv_id", "piece", "turns", "faults", "initials", "later"), fields, summary), "conversation-costs")

    def back(behind, r, begins, ends):
        m = r["costs"]
        before = _with_inserts([min(m[q * STATES + e] + behind[e] for e in range(STATES)) for q in range(STATES)])
        return before, (r["conv_id"], r["piece"], list(behind), begins)

    behind = _along(light.select("conv_id", "piece", "costs"), f"conv_id {kind}, piece long, behind array<long>, last boolean", TO_END, back, backwards=True)

    def exits(r):
        cost = backward(r["symbols"], tuple(r["behind"]))
        return (*[r[c] for c in ("conv_id", "piece", "behind", "last")], [_walk(r["symbols"], cost, q, r["last"]) for q in range(STATES)])

    fields = f"conv_id {kind}, piece long, behind array<long>, last boolean, exits array<int>"
    joined = light.select("conv_id", "piece", "symbols").join(behind.drop("conv_id"), "piece").select("conv_id", "piece", "symbols", "behind", "last")
    known = light.drop("symbols").join(_by_piece(joined, fields, exits).drop("conv_id"), "piece")

    def ahead(state, r, begins, ends):
        q, fore, tail, high, sums = state
        m = r["costs"]
        after = tuple(min(NEVER, min(fore[p] + m[p * STATES + e] for p in range(STATES))) for e in range(STATES))
        bad = r["illegal"] + (bool(tail and r["head"]) and tail + r["head"] not in LEGAL)
        low, top = (sums[0], sums[1]) if r["low"] is None else (r["low"] if sums[0] is None else sums[0], r["high"])
        distinct = r["distinct"] - (high is not None and high == r["low"])
        sums = (low, top, *[a + b for a, b in zip(sums[2:], [distinct, *r["numbers"], bad])])
        gaps = 0 if low is None else top - low + 1 - sums[2]
        # Behind the last piece nothing more than what is put in there is to be paid.
        cost = min(a + b for a, b in zip(after, r["behind"]))
        made = (r["conv_id"], r["piece"], q, list(fore), r["behind"], ends, gaps, *sums[3:], cost)
        return (r["exits"][q], after, r["tail"] or tail, top, sums), made

    fields = f"conv_id {kind}, piece long, state int, fore array<long>, behind array<long>, last boolean, " + ", ".join(f"{c} long" for c in COUNTS)
    start = (0, FROM_START, "", None, (None, None, 0, 0, 0, 0, 0))
    columns = ["conv_id", "piece", "head", "tail", "illegal", "low", "high", "distinct", "numbers", "costs", "behind", "exits"]
    borders = _along(known.select(*columns), fields, start, ahead)
    borders = borders.join(light.select("piece", "symbols"), "piece")

    def repaired(r):
        letters, given, _ = cheapest(r["symbols"], tuple(r["fore"]), tuple(r["behind"]), r["state"], r["last"])
        roles, texts = edited(letters, given, r["roles"], r["texts"])
        return (r["conv_id"], r["piece"], roles, texts, letters, r["last"], *[r[c] if r["last"] else None for c in COUNTS])

    fields = f"conv_id {kind}, piece long, roles array<string>, texts array<string>, audit string, last boolean, " + ", ".join(f"{c} long" for c in COUNTS)
    both = pieces.select("conv_id", "piece", "roles", "texts").join(borders.drop("conv_id"), "piece")
    _by_piece(both, fields, repaired).write.parquet(path)
    return spark.read.schema(", ".join(fields.split(", "))).parquet(path)


def _walk(symbols: str, cost: list[tuple[int, ...]], q: int, last: bool) -> int:
    """The state behind the rows on the least cheapest way from a state, which costs to the end alone tell."""
    i = 0
    while i < len(symbols) or last and q in (1, 2):
        steps = [("I", i, AFTER[q])] if cost[i][q] == INSERT + cost[i][AFTER[q]] else []
        if i < len(symbols):
            steps += [(letter, i + 1, to) for letter, c, to in ARCS[symbols[i]][q] if cost[i][q] == c + cost[i + 1][to]]
        _, i, q = min(steps)
    return q


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, the counts, audit and repaired_sha256 (of the rows ``role:text``, joined by line feeds) of what repair() returns:
    a row for each conversation. Pieces of one conversation are hashed one after the other, as the digest needs them."""
    import hashlib

    text = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    df = repaired.select("conv_id", "piece", "last", *COUNTS, "audit", F.size("roles").alias("n"), text.alias("rows"))
    kind = df.schema["conv_id"].dataType.simpleString()
    single = df.where("piece = 0 and last").select("conv_id", *COUNTS, "audit", F.sha2(F.col("rows").cast("binary"), 256).alias("repaired_sha256"))
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"

    def run(batches):
        import pyarrow as pa

        names, kinds = [f.split()[0] for f in schema.split(", ")], None
        sha, letters, any_rows = hashlib.sha256(), [], False
        for batch in batches:
            kinds = kinds or _arrow(schema, batch)
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                letters.append(r["audit"])
                if r["n"]:
                    sha.update((("\n" if any_rows else "") + r["rows"]).encode())
                    any_rows = True
                if r["last"]:
                    row = (r["conv_id"], *[r[c] for c in COUNTS], "".join(letters), sha.hexdigest())
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=kinds)
                    sha, letters, any_rows = hashlib.sha256(), [], False

    many = df.where("not (piece = 0 and last)").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, schema)
    return single.unionByName(many)


#: digests(repair(damage())) in DuckDB: a state's cheapest, then least edits are carried from row to row, for keys in ASCII.
ORACLE = r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
      FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM d, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM e),
f AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(regexp_replace(text, '[ \t\n\x0B\f\r]+$', ''), 1) AS final FROM n),
r AS (SELECT *, final = '' AS blank, final <> '' AND again AS duplicate, final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS truncated FROM f),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
             count(*) FILTER (WHERE before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
-- Of each state: cost, letters and rows of the edits so far (s0 nothing yet, s1 after the system's row, s2 a user's, s3 an assistant's), with what is put in.
p AS (
  SELECT conv_id, 0 AS i, {'c': 0, 'l': '', 'r': []::VARCHAR[]} AS s0, {'c': 99999999, 'l': '', 'r': []::VARCHAR[]} AS s1, {'c': 2, 'l': 'I', 'r': ['user:']} AS s2, {'c': 4, 'l': 'II', 'r': ['user:', 'assistant:']} AS s3 FROM c
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, least(s3, {'c': s2.c + 2, 'l': s2.l || 'I', 'r': list_append(s2.r, 'assistant:')}) AS s3 FROM (
    SELECT conv_id, i, s0, s1, s3, least(s2, {'c': s0.c + 2, 'l': s0.l || 'I', 'r': list_append(s0.r, 'user:')}, {'c': s1.c + 2, 'l': s1.l || 'I', 'r': list_append(s1.r, 'user:')}, {'c': s3.c + 2, 'l': s3.l || 'I', 'r': list_append(s3.r, 'user:')}) AS s2 FROM (
      SELECT conv_id, i, {'c': s0.c + 3, 'l': s0.l || 'D', 'r': s0.r} AS s0,
             least({'c': s1.c + 3, 'l': s1.l || 'D', 'r': s1.r}, {'c': s0.c + stay + CASE WHEN a = 's' THEN 0 ELSE 99999999 END, 'l': s0.l || 'K', 'r': list_append(s0.r, kept)}) AS s1,
             list_min(list_append(list_transform([s0, s1, s3], lambda s: CASE WHEN a = 'u' THEN {'c': s.c + stay, 'l': s.l || 'K', 'r': list_append(s.r, kept)} ELSE {'c': s.c + 2 + stay, 'l': s.l || 'R', 'r': list_append(s.r, 'user:' || text)} END), {'c': s2.c + 3, 'l': s2.l || 'D', 'r': s2.r})) AS s2,
             least({'c': s3.c + 3, 'l': s3.l || 'D', 'r': s3.r}, CASE WHEN a = 'a' THEN {'c': s2.c + stay, 'l': s2.l || 'K', 'r': list_append(s2.r, kept)} ELSE {'c': s2.c + 2 + stay, 'l': s2.l || 'R', 'r': list_append(s2.r, 'assistant:' || text)} END) AS s3
      FROM (SELECT p.*, r.text, left(r.role, 1) AS a, concat(r.role, ':', r.text) AS kept, CASE WHEN blank OR duplicate THEN 99999999 WHEN truncated THEN 1 ELSE 0 END AS stay
            FROM (SELECT conv_id, i + 1 AS i, s0, s1, s2, s3 FROM p) p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i)))),
w AS (SELECT p.conv_id, least(s0, s3) AS best FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.l, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON o.conv_id IS NOT DISTINCT FROM w.conv_id
"""
