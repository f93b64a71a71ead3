"""Sessions and state sequences over ``events`` (state = event type, key = user)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles, relational, sequences, sessions
from ..operators.skew import cut_lineage
from .tables import event_records, longs, rounded

STATES = ["click", "error", "purchase", "signup", "view"]
GAP_HOURS = 6.0
KEYS = ["user_id", "session_id"]


def _sessions(spark, d):
    return sessions.sessionize(event_records(spark, d), ["user_id"], "start_us", "end_us", "event_id", GAP_HOURS)


def parsed_records(spark, d):
    """Start times read from zoned text, and whether they fall in a closed range of local dates."""
    e = event_records(spark, d)
    written = F.date_format(sessions.utc_clock(F.col("start_us")), "yyyy-MM-dd HH:mm:ss")
    us = sessions.parse_clock(written, "Asia/Taipei")
    inside = sessions.started_within(us, "Asia/Taipei", "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return e.select("event_id", written.alias("written"), us.alias("start_us"), inside.alias("inside"))


def gap_hours(spark, d):
    out = sessions.sessionize(event_records(spark, d), ["user_id"], "start_us", "end_us", "event_id", 0.0)
    return rounded(out.select("event_id", "user_id", "gap_hours", F.col("session_id")), "gap_hours")


def sessionize(spark, d):
    return _sessions(spark, d).select("event_id", "user_id", "session_id")


def _durations(spark, d):
    return sessions.session_durations(_sessions(spark, d), KEYS, "start_us", "end_us", "state", STATES)


def session_durations(spark, d):
    return rounded(_durations(spark, d), *STATES, "total")


def duration_macro_mean(spark, d):
    by_user = relational.map_columns(_durations(spark, d), [*STATES, "total"], lambda c: c)
    return rounded(profiles.macro_mean(by_user, "user_id", [*STATES, "total"]), *STATES, "total")


def state_medians(spark, d):
    long = _durations(spark, d).unpivot(["month"], STATES, "variable", "value")
    q = profiles.quantile_summary(long, ["month", "variable"], "value", {"med": 0.5})
    return rounded(q.select("month", "variable", "n", "med"), "med")


def session_exclusion(spark, d):
    """Drop every session that holds an ``error`` record, renumber the rest densely."""
    s = _sessions(spark, d)
    kept = sessions.without_sessions(s, KEYS, s.where(F.col("state") == "error"))
    ids = relational.dense_ids(kept, KEYS, "dense_id")
    return kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).join(ids, KEYS).select(*KEYS, "dense_id", "n")


def session_clock(spark, d):
    out = sessions.fold_to_day(_sessions(spark, d), KEYS, "start_us", "end_us", "Asia/Taipei")
    return out.select("event_id", "session_id", "xmin", "xmax")


def _minutes(spark, d):
    return sessions.minute_states(_sessions(spark, d), KEYS, "start_us", "end_us", "state", "event_id")


def minute_states(spark, d):
    m = _minutes(spark, d)
    out = m.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_minutes"),
        F.max("pos").alias("last_pos"),
        F.min_by("state", "pos").alias("first_state"),
        F.max_by("state", "pos").alias("last_state"),
    )
    return longs(out, "n_minutes", "last_pos")


def _spells(spark, d):
    return sessions.record_spells(_sessions(spark, d), KEYS, "start_us", "end_us", "state", "event_id")


def state_distribution(spark, d):
    return rounded(sequences.spell_distribution(_spells(spark, d)), "share")


def _typed(spark, d):
    """Sessions with a type: the state they begin with."""
    first = _sessions(spark, d).groupBy(*KEYS).agg(
        F.min_by("state", F.struct("start_us", "event_id")).alias("type")
    )
    return first


def state_distribution_by_type(spark, d):
    m = _spells(spark, d).join(_typed(spark, d), KEYS)
    return rounded(sequences.spell_distribution(m, ["type"]), "share")


def modal_state(spark, d):
    return rounded(sequences.spell_modal_state(_spells(spark, d)), "share")


def transition_rates(spark, d):
    return rounded(sequences.spell_transitions(_spells(spark, d), KEYS), "rate")


def future_cost(spark, d):
    return rounded(sequences.future_cost(sequences.spell_transitions(_spells(spark, d), KEYS)), "cost")


def sequence_order(spark, d):
    """Sessions numbered in order of their states from the start, by 30-minute steps only: its SQL
    check is of that step. ``sequence_order_minutes`` is the order of the analysis."""
    m = sessions.minute_states(_sessions(spark, d), KEYS, "start_us", "end_us", "state", "event_id", 30)
    return longs(sequences.sequence_order(m, KEYS, STATES), "position")


def sequence_order_minutes(spark, d):
    """Sessions numbered in order of their states from the start, minute by minute."""
    out = sequences.record_order(_sessions(spark, d), KEYS, "start_us", "end_us", "state", "event_id", STATES)
    return longs(out, "position")


def state_shares(spark, d):
    return rounded(sequences.spell_shares(_spells(spark, d), KEYS, STATES), *[f"p_{s}" for s in STATES])


def near_sequences(spark, d):
    """Distinct share vectors closer than the radius, copies collapsed to one."""
    shares = rounded(sequences.spell_shares(_spells(spark, d), KEYS, STATES), *[f"p_{s}" for s in STATES])
    vecs = sequences.distinct_vectors(shares, [f"p_{s}" for s in STATES], F.concat_ws(":", *KEYS))
    out = sequences.near_pairs(vecs, "rep", [f"p_{s}" for s in STATES], 0.02)
    return rounded(out, "distance")


def sequence_distances(spark, d):
    """Edit distances of each session to the same user's session before it, minute by minute."""
    spells = cut_lineage(_spells(spark, d))
    rates = sequences.spell_transitions(spells, KEYS)
    lists = sequences.spell_lists(spells, KEYS)
    a = lists.select("user_id", F.col("session_id").alias("a_id"), F.col("spells").alias("a"))
    b = lists.select("user_id", (F.col("session_id") - 1).alias("a_id"), F.col("session_id").alias("b_id"), F.col("spells").alias("b"))
    pairs = a.join(b, ["user_id", "a_id"])
    return sequences.edit_distances(pairs, ["user_id", "a_id", "b_id"], sequences.future_cost(rates))


def sequence_clusters(spark, d):
    """Four session types by bisecting k-means on state shares, profiled by duration."""
    cols = [f"p_{s}" for s in STATES]
    shares = sequences.spell_shares(_spells(spark, d), KEYS, STATES)
    typed = sequences.cluster_sequences(shares, KEYS, cols, k=4)
    full = _durations(spark, d).join(typed, KEYS).withColumn("sid", F.concat_ws(":", *KEYS))
    return profiles.group_profile(full, "type", "sid", [*STATES, "total"])


def type_profile(spark, d):
    full = _durations(spark, d).join(_typed(spark, d), KEYS).withColumn("sid", F.concat_ws(":", *KEYS))
    return rounded(profiles.group_profile(full, "type", "sid", [*STATES, "total"]), "mean", "q1", "q2", "q3")


QUERIES = {
    f.__name__: f
    for f in (
        parsed_records, gap_hours,
        sessionize,
        session_durations,
        duration_macro_mean,
        state_medians,
        session_exclusion,
        session_clock,
        minute_states,
        state_distribution,
        state_distribution_by_type,
        modal_state,
        transition_rates,
        future_cost,
        sequence_order,
        sequence_order_minutes,
        state_shares,
        near_sequences,
        sequence_distances,
        sequence_clusters,
        type_profile,
    )
}

_REC = """
rec AS (
  SELECT user_id, event_id, event_type AS state, epoch_us(ts) AS s,
         epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS e
  FROM events
), lagged AS (
  SELECT *, (s - lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id)) / 3600000000.0 AS g FROM rec
)"""

_SES = (
    _REC
    + """, ses AS (
  SELECT user_id, event_id, state, s, e, CAST(sum(CASE WHEN g > 6 THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
  FROM lagged
)"""
)

_DUR = (
    _SES
    + ", dur AS (SELECT user_id, session_id, CAST(month(make_timestamp(min(s))) AS BIGINT) AS month, "
    + ", ".join(
        f"coalesce(sum(CASE WHEN state = '{s}' THEN (e - s) / 3600000000.0 END), 0) AS {s}" for s in STATES
    )
    + ", sum((e - s) / 3600000000.0) AS total FROM ses GROUP BY 1, 2)"
)


def _minutes_sql(step: int) -> str:
    us = step * 60000000
    return (
        _SES
        + f""", low AS (SELECT user_id, session_id, min(s) AS lo FROM ses GROUP BY 1, 2), tick AS (
  SELECT ses.user_id, ses.session_id, ses.state, ses.s, ses.event_id,
         (ses.s - lo + {us} * unnest(range(0, (ses.e - ses.s) // {us} + 1))) // {us} AS pos
  FROM ses JOIN low USING (user_id, session_id)
), mins AS (
  SELECT user_id, session_id, pos, arg_min(state, (s, event_id)) AS state FROM tick GROUP BY 1, 2, 3
)"""
    )


_MIN = _minutes_sql(1)
_LONG = " UNION ALL ".join(
    f"SELECT user_id, session_id, month, type, '{v}' AS variable, {v} AS value FROM typed" for v in [*STATES, "total"]
)
_RATES = (
    _MIN
    + """, nxt AS (
  SELECT state, lead(state) OVER w AS to_state, lead(pos) OVER w AS np, pos
  FROM mins WINDOW w AS (PARTITION BY user_id, session_id ORDER BY pos)
), steps AS (
  SELECT state AS from_state, to_state, count(*) AS n FROM nxt WHERE np = pos + 1 GROUP BY 1, 2
  UNION ALL SELECT state, 'missing', count(*) FROM nxt WHERE np > pos + 1 GROUP BY 1
  UNION ALL SELECT 'missing', to_state, count(*) FROM nxt WHERE np > pos + 1 GROUP BY 2
  UNION ALL SELECT 'missing', 'missing', CAST(sum(np - pos - 2) AS BIGINT) FROM nxt WHERE np > pos + 2
), rates AS (
  SELECT from_state, to_state, CAST(n AS BIGINT) AS n, n * 1.0 / sum(n) OVER (PARTITION BY from_state) AS rate FROM steps
)"""
)
_SHARES = (
    _MIN
    + ", shares AS (SELECT user_id, session_id, "
    + ", ".join(f"round(sum(CASE WHEN state = '{s}' THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS p_{s}" for s in STATES)
    + " FROM mins GROUP BY 1, 2)"
)
_P = ", ".join(f"p_{s}" for s in STATES)

SQL = {
    "parsed_records": """WITH t AS (SELECT event_id, date_trunc('second', ts) AS s FROM events)
        SELECT event_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS written, epoch_us(s) - 8 * 3600000000 AS start_us,
          s BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' AS inside FROM t""",
    "gap_hours": f"""WITH {_REC} SELECT event_id, user_id, round(coalesce(g, 0), 6) AS gap_hours,
        CAST(sum(CASE WHEN g > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM lagged""",
    "sessionize": f"WITH {_SES} SELECT event_id, user_id, session_id FROM ses",
    "session_durations": f"WITH {_DUR} SELECT user_id, session_id, month, "
    + ", ".join(f"round({v}, 6) AS {v}" for v in [*STATES, "total"])
    + " FROM dur",
    "duration_macro_mean": f"WITH {_DUR}, m AS (SELECT user_id, "
    + ", ".join(f"avg({v}) AS {v}" for v in [*STATES, "total"])
    + " FROM dur GROUP BY 1) SELECT "
    + ", ".join(f"round(avg({v}), 6) AS {v}" for v in [*STATES, "total"])
    + " FROM m",
    "state_medians": f"WITH {_DUR}, l AS ("
    + " UNION ALL ".join(f"SELECT month, '{s}' AS variable, {s} AS value FROM dur" for s in STATES)
    + ") SELECT month, variable, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS med FROM l GROUP BY 1, 2",
    "session_exclusion": f"""WITH {_SES}, kept AS (
        SELECT user_id, session_id, count(*) AS n FROM ses
        WHERE (user_id, session_id) NOT IN (SELECT (user_id, session_id) FROM ses WHERE state = 'error') GROUP BY 1, 2)
        SELECT user_id, session_id, row_number() OVER (ORDER BY user_id, session_id) AS dense_id, n FROM kept""",
    "session_clock": f"""WITH {_SES}, low AS (
          SELECT user_id, session_id, CAST(make_timestamp(min(s)) + INTERVAL 8 HOUR AS DATE) AS d0 FROM ses GROUP BY 1, 2),
        z AS (SELECT *, make_timestamp(s) + INTERVAL 8 HOUR AS ls, make_timestamp(e) + INTERVAL 8 HOUR AS le
              FROM ses JOIN low USING (user_id, session_id))
        SELECT event_id, session_id,
          CAST(date_diff('day', d0, CAST(ls AS DATE)) * 86400 + hour(ls) * 3600 + minute(ls) * 60 + second(ls) AS BIGINT) AS xmin,
          CAST(date_diff('day', d0, CAST(le AS DATE)) * 86400 + hour(le) * 3600 + minute(le) * 60 + second(le) AS BIGINT) AS xmax
        FROM z""",
    "minute_states": f"""WITH {_MIN} SELECT user_id, session_id, count(*) AS n_minutes, CAST(max(pos) AS BIGINT) AS last_pos,
        arg_min(state, pos) AS first_state, arg_max(state, pos) AS last_state FROM mins GROUP BY 1, 2""",
    "state_distribution": f"""WITH {_MIN}, c AS (SELECT pos, state, count(*) AS n FROM mins GROUP BY 1, 2)
        SELECT CAST(pos AS BIGINT) AS pos, state, n, round(n * 1.0 / sum(n) OVER (PARTITION BY pos), 6) AS share FROM c""",
    "state_distribution_by_type": f"""WITH {_MIN}, t AS (
          SELECT user_id, session_id, arg_min(state, (s, event_id)) AS type FROM ses GROUP BY 1, 2),
        c AS (SELECT type, pos, mins.state, count(*) AS n FROM mins JOIN t USING (user_id, session_id) GROUP BY 1, 2, 3)
        SELECT type, CAST(pos AS BIGINT) AS pos, state, n,
               round(n * 1.0 / sum(n) OVER (PARTITION BY type, pos), 6) AS share FROM c""",
    "modal_state": f"""WITH {_MIN}, c AS (SELECT pos, state, count(*) AS n FROM mins GROUP BY 1, 2),
        r AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY pos) AS share,
              row_number() OVER (PARTITION BY pos ORDER BY n DESC, state) AS k FROM c)
        SELECT CAST(pos AS BIGINT) AS pos, state, n, round(share, 6) AS share FROM r WHERE k = 1""",
    "transition_rates": f"WITH {_RATES} SELECT from_state, to_state, n, round(rate, 6) AS rate FROM rates",
    "future_cost": f"""WITH {_RATES}, st AS (SELECT DISTINCT from_state AS a FROM rates),
        cols AS (SELECT DISTINCT to_state AS c FROM rates),
        tot AS (SELECT to_state AS c, sum(rate) / (SELECT sum(rate) FROM rates) AS w FROM rates GROUP BY 1),
        grid AS (SELECT a, c, coalesce(rate, 0) AS p FROM st CROSS JOIN cols LEFT JOIN rates ON from_state = a AND to_state = c)
        SELECT x.a AS a, y.a AS b, round(sqrt(sum((x.p - y.p) * (x.p - y.p) / w)), 6) AS cost
        FROM grid x JOIN grid y ON x.c = y.c AND x.a <> y.a JOIN tot ON tot.c = x.c GROUP BY 1, 2""",
    "sequence_order": f"""WITH {_minutes_sql(30)}, l AS (
          SELECT user_id, session_id, list(array_position(['{"', '".join(STATES)}'], state) ORDER BY pos) AS codes
          FROM mins GROUP BY 1, 2)
        SELECT user_id, session_id, row_number() OVER (ORDER BY codes, user_id, session_id) AS position FROM l""",
    "sequence_order_minutes": f"""WITH {_MIN}, l AS (
          SELECT user_id, session_id, list(array_position(['{"', '".join(STATES)}'], state) ORDER BY pos) AS codes
          FROM mins GROUP BY 1, 2)
        SELECT user_id, session_id, row_number() OVER (ORDER BY codes, user_id, session_id) AS position FROM l""",
    "state_shares": f"WITH {_SHARES} SELECT user_id, session_id, {_P} FROM shares",
    "near_sequences": f"""WITH {_SHARES}, v AS (
          SELECT min(concat_ws(':', user_id, session_id)) AS rep, {_P} FROM shares GROUP BY {_P})
        SELECT x.rep AS a, y.rep AS b, round(sqrt({" + ".join(f"(x.p_{s} - y.p_{s}) ** 2" for s in STATES)}), 6) AS distance
        FROM v x JOIN v y ON x.rep < y.rep
        WHERE sqrt({" + ".join(f"(x.p_{s} - y.p_{s}) ** 2" for s in STATES)}) <= 0.02""",
    "type_profile": f"""WITH {_DUR}, typed AS (
          SELECT * FROM dur JOIN (SELECT user_id, session_id, arg_min(state, (s, event_id)) AS type FROM ses GROUP BY 1, 2)
          USING (user_id, session_id)), l AS ({_LONG})
        SELECT type, variable, count(DISTINCT (user_id, session_id)) AS n, round(avg(value), 6) AS mean,
               round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2,
               round(quantile_cont(value, 0.75), 6) AS q3 FROM l GROUP BY 1, 2""",
}
