"""Point-in-time join: as-of look-ups and trailing range aggregates of a
right table, evaluated at the times of a left table.

Plan (all DataFrame operations, no per-row Python):

* Both sides are cut into day buckets ``(key, day)``; a bucket of the left
  side that is larger than ``rows_per_slice`` is split into salted slices,
  so one hot key never lands in one task.
* Pass 1 evaluates the rolling aggregates at the right side's *break
  points* only: every right row (it enters the frames) and every right row
  shifted by ``width + 1us`` (it leaves a frame). A frame therefore never
  holds left rows, and its cost is bounded by the right side's density.
  Time is cut into *panes*, of which every width is a multiple. A frame is
  the rows of the point's own pane up to it, the whole panes between, and
  the rows of the frame's first pane from its start on: two growing frames
  (O(1) per row, none slides) around aggregates of whole panes, made once
  per pane. A task holds one pane of a key, not a day.
* Pass 2 unions the left rows of a slice with the break points (and right
  rows) of the same and the previous day, plus one carried row (the newest
  right row before that), and takes ``max(struct(time, ...))`` over growing
  frames: O(1) amortised per row whatever the left density.

Big data crosses the network twice (pass 1 on right rows, pass 2 on left
rows plus replicated break points); all other exchanges move day-level
counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import micros
from tidemark.schemas import DAY_US


@dataclass(frozen=True)
class AsOf:
    """Newest right row with ``right_time <= left_time - lag_us``."""
    name: str
    columns: tuple[str, ...]
    lag_us: int = 0


@dataclass(frozen=True)
class Rolling:
    """``fn(column)`` over right rows with time in ``[t - width_us, t]`` (both ends inclusive)."""
    name: str
    fn: str
    column: str
    width_us: int


_AGG = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}

# internal column names
_T, _D, _S, _SALT, _K, _REP, _P = "_pt_t", "_pt_d", "_pt_s", "_pt_salt", "_pt_kind", "_pt_rep", "_pt_pane"
_AS, _RS, _LAST, _ISL = "_pt_as", "_pt_rs", "_pt_last", "_pt_isleft"
ENTER, EXIT, CARRY, LEFT = 0, 1, 2, 3


def _floor_div(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n)).cast("long")


def _merged(fn: str, parts: list[Column]) -> Column:
    """``sum`` (NULL only if all parts are), ``min``, ``max`` or ``count`` over parts of a frame."""
    if len(parts) == 1:
        return parts[0]
    if fn == "min":
        return F.least(*parts)
    if fn == "max":
        return F.greatest(*parts)
    total = F.coalesce(parts[0], F.lit(0))
    for c in parts[1:]:
        total = total + F.coalesce(c, F.lit(0))
    return total if fn == "count" else F.when(F.coalesce(*parts).isNotNull(), total)


def _needs(r: Rolling) -> list[str]:
    return ["sum", "count"] if r.fn == "avg" else [r.fn]


def _between(r: Rolling, fn: str) -> str:
    return f"_pt_m_{fn}_{r.width_us}_{r.column}"


def _paned(r: Rolling, key: str, copy: int, panes: int) -> Column:
    """A frame ``[t - W, t]`` of ``panes`` panes at a break point ``t``.

    The rows of its own pane up to ``t`` (ascending, growing), what whole
    panes between give (``_between``), and the copies of the frame's first
    pane from ``t - W`` on (descending, growing). Spark evaluates growing
    frames incrementally, so this costs O(1) per row where a sliding frame
    re-aggregates its whole buffer (about W of data) for every row.
    """
    own = F.when(F.col(_REP) == 0, F.col(r.column))
    first = F.when(F.col(_REP) == copy, F.col(r.column))
    up = Window.partitionBy(key, _P).orderBy(F.col(_T)).rangeBetween(Window.unboundedPreceding, 0)
    down = (Window.partitionBy(key, _P).orderBy(F.col(_T).desc())
            .rangeBetween(Window.unboundedPreceding, r.width_us))
    got = {fn: _merged(fn, [_AGG[fn](own).over(up), _AGG[fn](first).over(down)]
                       + ([F.col(_between(r, fn))] if panes > 1 else [])) for fn in _needs(r)}
    if r.fn == "avg":
        return F.when(got["count"] > 0, got["sum"].cast("double") / got["count"])
    return got[r.fn]


def _whole_panes(rows: DataFrame, key: str, rolling: list[Rolling], pane_us: int) -> DataFrame | None:
    """Per key and pane, aggregates of the whole panes strictly inside the frames that end in it."""
    wide = [r for r in rolling if r.width_us > pane_us]
    if not wide:
        return None
    made = list(dict.fromkeys((fn, r.column) for r in wide for fn in _needs(r)))
    base = rows.groupBy(key, _floor_div(F.col(_T), pane_us).alias(_P)).agg(
        *[_AGG[fn](c).alias(f"{fn} {c}") for fn, c in made])
    longest = max(r.width_us for r in wide) // pane_us
    ahead = base.withColumn("_pt_step", F.explode(F.sequence(F.lit(1), F.lit(longest - 1))))
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    aggs = {}
    for r in wide:
        inside = F.col("_pt_step") < r.width_us // pane_us
        for fn in _needs(r):
            aggs[_between(r, fn)] = merge[fn](F.when(inside, F.col(f"`{fn} {r.column}`"))).alias(_between(r, fn))
    return ahead.groupBy(key, (F.col(_P) + F.col("_pt_step")).alias(_P)).agg(*aggs.values())


def point_in_time(left: DataFrame, right: DataFrame, *, key: str, left_time: str,
                  right_time: str, asof: list[AsOf] = (), rolling: list[Rolling] = (),
                  tiebreak: tuple[str, ...] = (), bucket_us: int = DAY_US,
                  rows_per_slice: int = 1_000_000, max_broadcast_buckets: int = 100_000,
                  carried: DataFrame | None = None) -> DataFrame:
    """Left rows with one struct column per ``AsOf`` and one column per ``Rolling``.

    Rows of ``left`` with a NULL key or time get NULL results; right rows
    with a NULL key or time never match (as in a join).

    Only *hot* buckets (more than ``rows_per_slice`` left rows) are sliced,
    the largest ``max_broadcast_buckets`` of them: that many rows at most are
    broadcast, and no other bucket has more than ``|left| /
    max_broadcast_buckets`` rows. Nothing runs while the plan is built.

    ``carried`` replaces the scan of the whole right side for look-backs of
    more than two buckets: rows like ``right``'s, at least the newest one of
    each key and bucket (``sources.readings``). ``right`` then needs only the
    buckets of the left rows and the two before each.
    """
    asof, rolling = list(asof), list(rolling)
    longest = max([a.lag_us for a in asof] + [r.width_us for r in rolling] + [0])
    if longest > bucket_us:
        raise ValueError(f"bucket_us ({bucket_us}) must cover the longest look-back ({longest})")
    for r in rolling:
        if r.fn not in _AGG:
            raise ValueError(f"unsupported rolling function {r.fn!r}")

    left_cols = left.columns
    payload = list(dict.fromkeys([c for a in asof for c in a.columns]))
    roll_cols = list(dict.fromkeys(r.column for r in rolling))
    only_rolling = [c for c in roll_cols if c not in payload and c not in tiebreak]

    valid_left = F.col(key).isNotNull() & F.col(left_time).isNotNull()
    lt = micros(left_time)
    L = (left.where(valid_left)
         .withColumn(_T, lt)
         .withColumn(_D, _floor_div(F.col(_T), bucket_us))
         .withColumn("_pt_h", F.xxhash64(*[F.col(f.name) for f in left.schema.fields
                                            if not isinstance(f.dataType, T.MapType)])))

    # Left rows per bucket -> number of salted slices for that bucket.
    Lc = (L.groupBy(key, _D).agg(F.count(F.lit(1)).alias("_pt_n"))
          .select(key, _D, F.greatest(F.lit(1), F.ceil(F.col("_pt_n") / F.lit(rows_per_slice)))
                  .cast("int").alias(_S)))
    hot = Lc.where(F.col(_S) > 1).orderBy(F.desc(_S), key, _D).limit(max_broadcast_buckets)

    def with_slices(df: DataFrame) -> DataFrame:
        """Attach the slice count of each row's bucket (1 unless hot)."""
        return df.join(F.broadcast(hot), [key, _D], "left").withColumn(_S, F.coalesce(F.col(_S), F.lit(1)))

    L = (with_slices(L)
         .withColumn(_SALT, F.pmod(F.col("_pt_h"), F.col(_S)).cast("int"))
         .drop("_pt_h", _S)
         .withColumn(_K, F.lit(LEFT)))

    def timed(df: DataFrame) -> DataFrame:
        return (df.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
                .select(F.col(key), micros(right_time).alias(_T),
                        *[F.col(c) for c in dict.fromkeys(list(tiebreak) + payload + roll_cols)])
                .withColumn(_D, _floor_div(F.col(_T), bucket_us)))

    R = timed(right)
    as_struct = F.struct(F.col(_T), *[F.col(c).alias(f"_pt_tb{n}") for n, c in enumerate(tiebreak)],
                         *[F.col(c) for c in payload])

    # The readings any left bucket sees besides its carried row: its own day and
    # the days its frames reach back into. All copies below are made of these.
    reach = 2 if rolling else 1
    seen = Lc.select(key, F.explode(F.sequence(F.col(_D) - reach, F.col(_D))).alias(_D))
    near = R.join(seen, [key, _D], "left_semi")

    # ---- pass 1: rolling aggregates at the break points of the right side
    if rolling:
        widths = sorted({r.width_us for r in rolling})
        pane_us = gcd(bucket_us, *widths)
        # Every right row yields, in one pass: itself in its own pane, a copy
        # in the last pane of each frame that begins in its pane, and one exit
        # point per width.
        events = [F.struct(F.lit(ENTER).alias("k"), F.lit(0).alias("rep"), F.col(_T).alias("t"), F.lit(0).cast("bigint").alias("ahead"))]
        for n, w in enumerate(widths, 1):
            events += [F.struct(F.lit(ENTER).alias("k"), F.lit(n).alias("rep"), F.col(_T).alias("t"), F.lit(w // pane_us).cast("bigint").alias("ahead")),
                       F.struct(F.lit(EXIT).alias("k"), F.lit(0).alias("rep"), (F.col(_T) + F.lit(w + 1)).alias("t"), F.lit(0).cast("bigint").alias("ahead"))]
        taken = list(dict.fromkeys(list(tiebreak) + payload + roll_cols))
        enter = F.col("_pt_e.k") == ENTER
        P1 = (near.select(key, *taken, F.explode(F.array(*events)).alias("_pt_e"))
              .select(key, F.col("_pt_e.t").alias(_T), F.col("_pt_e.k").alias(_K), F.col("_pt_e.rep").alias(_REP),
                      (_floor_div(F.col("_pt_e.t"), pane_us) + F.col("_pt_e.ahead")).alias(_P),
                      *[F.when(enter, F.col(c)).alias(c) for c in taken]))
        P1 = P1.withColumn(_D, _floor_div(F.col(_P) * pane_us, bucket_us))
        # Only the buckets pass 2 reads: a left bucket and the day before it.
        # (a semi join ignores duplicate keys, so no distinct is needed)
        needed = Lc.select(key, F.explode(F.array(F.col(_D), F.col(_D) - 1)).alias(_D))
        P1 = P1.join(needed, [key, _D], "left_semi")
        inside = _whole_panes(near, key, rolling, pane_us)
        if inside is not None:
            P1 = P1.join(inside, [key, _P], "left")
        # One select, so the planner groups the window expressions into one
        # ascending and one descending Window operator (two sorts in all).
        P1 = P1.select(*[F.col(c) for c in (key, _T, _K, _REP, *taken)], *[
            _paned(r, key, 1 + widths.index(r.width_us), r.width_us // pane_us).alias(r.name) for r in rolling])
        RT = P1.where(F.col(_REP) == 0).drop(_REP, *only_rolling)
    else:
        RT = near.withColumn(_K, F.lit(ENTER)).drop(_D, *only_rolling)

    # ---- carried as-of row: newest right row at least one full bucket
    # before the bucket's replicated history starts (day <= d - 2).
    Rlast = (R if carried is None else timed(carried)).groupBy(key, _D).agg(F.max(as_struct).alias(_LAST))
    cw = Window.partitionBy(key).orderBy(_D).rangeBetween(Window.unboundedPreceding, 0)
    C = (Rlast.select(key, (F.col(_D) + 2).alias(_D), _LAST, F.lit(False).alias(_ISL))
         .unionByName(Lc.withColumn(_ISL, F.lit(True)), allowMissingColumns=True)
         .withColumn(_AS, F.max(_LAST).over(cw))
         .where(F.col(_ISL) & F.col(_AS).isNotNull())
         .select(key, _D, F.explode(F.sequence(F.lit(0), F.col(_S) - 1)).alias(_SALT),
                 F.col(_AS)[_T].alias(_T), _AS, F.lit(CARRY).alias(_K)))

    # ---- pass 2: replicate break points to their own and the next bucket,
    # into every slice of that bucket, and look up as-of rows.
    RT2 = with_slices(RT.withColumn(_D, F.explode(F.array(_floor_div(F.col(_T), bucket_us),
                                                           _floor_div(F.col(_T), bucket_us) + 1))))
    RT2 = (RT2.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.col(_S) - 1)))
           .drop(_S))
    RT2 = RT2.withColumn(_AS, F.when(F.col(_K) == ENTER, as_struct))
    if rolling:
        RT2 = RT2.withColumn(_RS, F.struct(F.col(_T), *[F.col(r.name) for r in rolling]))
    U = (L.unionByName(RT2.drop(*[c for c in RT2.columns if c in payload or c in tiebreak]
                                 + [r.name for r in rolling]), allowMissingColumns=True)
         .unionByName(C, allowMissingColumns=True))

    w2 = Window.partitionBy(key, _D, _SALT).orderBy(_T)
    outs = []
    for a in asof:
        frame = w2.rangeBetween(Window.unboundedPreceding, -a.lag_us)
        U = U.withColumn(a.name, F.max(_AS).over(frame))
        outs.append(F.when(F.col(a.name).isNotNull(),
                           F.struct(*[F.col(a.name)[c].alias(c) for c in a.columns])).alias(a.name))
    if rolling:
        U = U.withColumn(_RS, F.max(_RS).over(w2.rangeBetween(Window.unboundedPreceding, 0)))
        # No break point at or before t: the frame is empty (count 0, else NULL).
        outs += [(F.coalesce(F.col(_RS)[r.name], F.lit(0)) if r.fn == "count" else F.col(_RS)[r.name]).alias(r.name)
                 for r in rolling]
    result = U.where(F.col(_K) == LEFT).select(*[F.col(c) for c in left_cols], *outs)

    dropped = left.where(~valid_left)
    return result.unionByName(dropped, allowMissingColumns=True)
