"""Command-log, invariant and streaming queries over logs derived from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import order_by
from ..sources import wal
from ..streaming import invariants, log, stream
from .registry import load, query

_COMMANDS = """WITH c AS (SELECT event_id AS idx, CASE WHEN event_type IN ('signup', 'purchase') THEN 'put' WHEN event_type = 'error' THEN 'delete' ELSE 'cas' END AS op, 'k' || user_id AS key, 'v' || (event_id % 4) AS value,
'v' || (event_id % 3) AS expect, event_type = 'view' AS expect_absent, user_id % 8 AS client_id, event_id - (event_id % 5) * 20 AS request_id FROM events),
m AS (SELECT *, coalesce(client_id <> 0 AND request_id <= max(request_id) OVER (PARTITION BY client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS replayed FROM c)
"""


def _commands(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "put").when(F.col("event_type") == "error", "delete").otherwise("cas")
    number = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    i, u = F.col("event_id"), F.col("user_id")
    return events.select(
        i.alias("idx"), kind.alias("op"), number("k", u).alias("key"), number("v", i % 4).alias("value"), number("v", i % 3).alias("expect"),
        (F.col("event_type") == "view").alias("expect_absent"), (u % 8).alias("client_id"), (i - (i % 5) * 20).alias("request_id"),
    )


def _fold(where: str = "TRUE") -> str:
    """The state of every key by a left fold over its ordered commands."""
    return f""", k AS (SELECT key, list({{'op': op, 'v': value, 'x': expect, 'a': expect_absent}} ORDER BY idx) AS steps FROM m WHERE NOT replayed AND {where} GROUP BY key),
s AS (SELECT key, list_reduce(list_prepend({{'op': '', 'v': NULL::VARCHAR, 'x': '', 'a': FALSE}}, steps), lambda s, t: {{'op': '', 'v': CASE WHEN t.op = 'put' THEN t.v WHEN t.op = 'delete' THEN NULL
WHEN (t.a AND s.v IS NULL) OR (NOT t.a AND s.v IS NOT NULL AND s.v = t.x) THEN t.v ELSE s.v END, 'x': '', 'a': FALSE}}).v AS value FROM k)
"""


@query(_COMMANDS + "SELECT idx, client_id, request_id, replayed FROM m")
def kv_replays(spark, d):
    return log.with_replays(_commands(load(spark, d, "events"))).select("idx", "client_id", "request_id", "replayed")


@query(_COMMANDS + _fold() + "SELECT key, value FROM s WHERE value IS NOT NULL")
def kv_state(spark, d):
    return log.state_as_of(_commands(load(spark, d, "events")))


@query(_COMMANDS + _fold("idx <= 500") + "SELECT key, value FROM s WHERE value IS NOT NULL")
def kv_state_as_of(spark, d):
    """A read at log index 500: replays are judged by the log up to there."""
    return log.state_as_of(_commands(load(spark, d, "events")), 500)


@query(_COMMANDS + _fold() + "SELECT key FROM s WHERE value IS NOT NULL ORDER BY key")
def kv_keys(spark, d):
    return log.keys(log.state_as_of(_commands(load(spark, d, "events"))))


@query(_COMMANDS.replace("FROM events)", "FROM events WHERE event_type NOT IN ('click', 'view'))") + """, p AS (SELECT * FROM m WHERE NOT replayed),
b AS (SELECT *, lag(CASE WHEN op = 'put' THEN value END) OVER (PARTITION BY key ORDER BY idx) AS previous FROM p)
SELECT idx, key, client_id, request_id, op = 'put' OR previous IS NOT NULL AS applied, previous, previous IS NOT NULL AS existed FROM b""")
def kv_results(spark, d):
    """The result of each put and delete: whether it applied, and what was there."""
    return log.results(_commands(load(spark, d, "events")).filter("op <> 'cas'"))


_WITH_CAS = """, k AS (SELECT key, list({'i': idx, 'op': op, 'v': value, 'x': expect, 'a': expect_absent, 's': NULL::VARCHAR, 'out': []::STRUCT(i BIGINT, a BOOLEAN, p VARCHAR, e BOOLEAN)[]} ORDER BY idx) AS steps FROM m WHERE NOT replayed GROUP BY key),
f AS (SELECT list_reduce(list_prepend({'i': 0::BIGINT, 'op': '', 'v': '', 'x': '', 'a': FALSE, 's': NULL::VARCHAR, 'out': []::STRUCT(i BIGINT, a BOOLEAN, p VARCHAR, e BOOLEAN)[]}, steps), lambda s, t: {'i': 0::BIGINT, 'op': '', 'v': '', 'x': '', 'a': FALSE,
  's': CASE WHEN t.op = 'delete' THEN NULL WHEN t.op = 'put' OR (t.a AND s.s IS NULL) OR (NOT t.a AND s.s = t.x) THEN t.v ELSE s.s END,
  'out': list_append(s.out, {'i': t.i, 'a': CASE WHEN t.op = 'put' THEN TRUE WHEN t.op = 'delete' THEN s.s IS NOT NULL WHEN t.a THEN s.s IS NULL ELSE coalesce(s.s = t.x, FALSE) END, 'p': s.s, 'e': s.s IS NOT NULL})}).out AS out FROM k),
r AS (SELECT unnest(out) AS o FROM f),
w AS (SELECT idx, replayed, CASE WHEN replayed THEN max(CASE WHEN NOT replayed THEN idx END) OVER (PARTITION BY client_id ORDER BY idx) ELSE idx END AS source FROM m)
SELECT w.idx, w.replayed, r.o.a AS applied, r.o.p AS previous, r.o.e AS existed FROM w JOIN r ON r.o.i = w.source"""


@query(_COMMANDS + _WITH_CAS)
def kv_results_with_cas(spark, d):
    """The result of every command; a replay gets that of its client's latest request before it."""
    return log.all_results(_commands(load(spark, d, "events")))


@query(_COMMANDS + _fold() + "SELECT key, value FROM s WHERE value IS NOT NULL")
def kv_snapshot_and_tail(spark, d):
    """A snapshot of the first half of the effective log, restored with the rest, is the state of the whole."""
    commands = log.effective(_commands(load(spark, d, "events"))).withColumn("client_id", F.lit(0).cast("long"))
    middle = commands.agg((F.max("idx") / 2).cast("long").alias("m")).first().m
    return log.restore(log.state_as_of(commands, middle), commands, middle)


@query("""WITH c AS (SELECT user_id % 11 AS grp, event_id AS idx, CASE WHEN event_type IN ('error', 'view') THEN 'remove' ELSE 'add' END AS op, user_id % 6 AS node FROM events),
k AS (SELECT grp, list({'op': op, 'n': node, 's': []::BIGINT[]} ORDER BY idx) AS steps FROM c GROUP BY grp),
s AS (SELECT grp, list_reduce(list_prepend({'op': '', 'n': 0, 's': [0, 1, 2]::BIGINT[]}, steps), lambda v, t: {'op': '', 'n': 0, 's': CASE WHEN t.op = 'add' THEN list_distinct(list_append(v.s, t.n)) WHEN len(list_filter(v.s, lambda x: x <> t.n)) > 0 THEN list_filter(v.s, lambda x: x <> t.n) ELSE v.s END}).s AS voters FROM k)
SELECT grp, unnest(voters) AS node FROM s""")
def membership(spark, d):
    remove = F.col("event_type").isin("error", "view")
    changes = load(spark, d, "events").select((F.col("user_id") % 11).alias("grp"), F.col("event_id").alias("idx"), F.when(remove, "remove").otherwise("add").alias("op"), (F.col("user_id") % 6).alias("node"))
    return log.members_after(changes, [0, 1, 2])


@query("""WITH c AS (SELECT user_id % 11 AS grp, event_id AS idx, CASE WHEN event_type IN ('error', 'view') THEN 'remove' ELSE 'add' END AS op, user_id % 6 AS node, event_id - 1 - (event_id * 7) % 60 AS applied FROM events),
k AS (SELECT grp, list({'op': op, 'n': node, 'a': applied, 'i': idx, 's': []::BIGINT[], 'h': []::BIGINT[]} ORDER BY idx) AS steps FROM c GROUP BY grp),
s AS (SELECT grp, list_reduce(list_prepend({'op': '', 'n': 0, 'a': 0, 'i': 0, 's': [0, 1, 2]::BIGINT[], 'h': []::BIGINT[]}, steps), lambda v, t:
  CASE WHEN coalesce(v.h[-1] <= t.a, TRUE) AND (t.op = 'add' OR (list_contains(v.s, t.n) AND len(v.s) > 1))
  THEN {'op': '', 'n': 0, 'a': 0, 'i': 0, 's': CASE WHEN t.op = 'add' THEN list_distinct(list_append(v.s, t.n)) ELSE list_filter(v.s, lambda x: x <> t.n) END, 'h': list_append(v.h, t.i)} ELSE v END).h AS stood FROM k)
SELECT grp, unnest(stood) AS idx FROM s""")
def membership_in_flight(spark, d):
    """Proposals against a group's log, one change in flight."""
    remove, i = F.col("event_type").isin("error", "view"), F.col("event_id")
    proposals = load(spark, d, "events").select((F.col("user_id") % 11).alias("grp"), i.alias("idx"), F.when(remove, "remove").otherwise("add").alias("op"), (F.col("user_id") % 6).alias("node"), (i - 1 - (i * 7) % 60).alias("applied"))
    return log.admitted(proposals, [0, 1, 2])


@query("SELECT event_id AS idx, greatest(user_id, least(event_id, user_id + 40)) AS committed FROM events")
def log_commit_to(spark, d):
    committed = log.commit_to(F.col("user_id"), F.col("event_id"), F.col("user_id") + 40)
    return load(spark, d, "events").select(F.col("event_id").alias("idx"), committed.alias("committed"))


@query(_COMMANDS.replace("FROM events)", "FROM events WHERE event_id <= (SELECT max(event_id) FROM events WHERE event_id % 3 = 1) - 40)") + _fold() + "SELECT key, value FROM s WHERE value IS NOT NULL")
def kv_stale_read(spark, d):
    """What a node that is forty entries behind answers."""
    events = load(spark, d, "events")
    progress = events.select((F.col("event_id") % 3).alias("node"), (F.col("event_id") - 40).alias("applied"))
    return log.stale_state(_commands(events), progress, 1)


def _log(spark, d) -> DataFrame:
    """One log per group of users; terms are 0 and 1."""
    return load(spark, d, "events").select((F.col("user_id") % 20).alias("grp"), F.col("event_id").alias("idx"), (F.col("user_id") % 2).alias("term"))


@query("""WITH p AS (SELECT user_id % 20 AS grp, event_id % 5 AS node, max(event_id) AS match FROM events GROUP BY ALL),
a AS (SELECT grp, list_reverse_sort(list(match))[(count(*) // 2 + 1)::BIGINT] AS idx FROM p GROUP BY grp)
SELECT a.grp, a.idx AS commit FROM a JOIN events ON event_id = a.idx AND user_id % 20 = a.grp WHERE user_id % 2 = 1""")
def quorum_commit(spark, d):
    progress = load(spark, d, "events").groupBy((F.col("user_id") % 20).alias("grp"), (F.col("event_id") % 5).alias("node")).agg(F.max("event_id").alias("match"))
    return log.quorum_commit(progress, _log(spark, d), 1)


_ARRIVALS = "WITH a AS (SELECT event_id AS arrival, event_id - (event_id % 7) * 9 AS idx, event_id // 50 AS term, event_type AS data FROM events)"


@query(_ARRIVALS + """, c AS (SELECT *, lag(term) OVER (PARTITION BY idx ORDER BY arrival) AS before FROM a),
n AS (SELECT idx, arg_max({'a': arrival, 't': term, 'd': data}, arrival) AS e FROM c WHERE before IS NULL OR before <> term GROUP BY idx)
SELECT idx, n.e.t AS term, n.e.d AS data FROM n WHERE NOT EXISTS (SELECT 1 FROM n AS o WHERE o.idx < n.idx AND o.e.a > n.e.a)""")
def log_effective(spark, d):
    i = F.col("event_id")
    arrivals = load(spark, d, "events").select(i.alias("arrival"), (i - (i % 7) * 9).alias("idx"), F.floor(i / 50).alias("term"), F.col("event_type").alias("data"))
    return log.effective_log(arrivals)


@query("SELECT user_id % 20 AS grp, event_id AS idx, user_id % 2 AS term FROM events WHERE event_id >= 100 AND event_id < 164")
def log_slice(spark, d):
    return log.log_slice(_log(spark, d), 100)


@query("SELECT user_id % 20 AS grp, event_id AS idx, user_id % 2 AS term FROM events WHERE event_id > 200 AND event_id <= 456 AND event_id <= 700")
def log_next_applicable(spark, d):
    return log.next_applicable(_log(spark, d), 200, 700)


@query("SELECT user_id % 20 AS grp, event_id AS idx, user_id % 2 AS term FROM events WHERE event_id > 300")
def log_compact(spark, d):
    return log.compact(_log(spark, d), 300)


@query("SELECT event_id AS idx, event_id // 70 > 5 OR (event_id // 70 = 5 AND event_id >= 360) AS up_to_date FROM events")
def log_up_to_date(spark, d):
    """Whether a candidate whose log ends at an entry may win the vote of a node whose log ends at term 5, index 360."""
    i = F.col("event_id")
    return load(spark, d, "events").select(i.alias("idx"), log.is_up_to_date(F.floor(i / 70), i, F.lit(5), F.lit(360)).alias("up_to_date"))


@query("SELECT 5::BIGINT AS term, min(event_id) AS first FROM events WHERE event_id // 70 = 5 AND event_id <= 377")
def log_find_conflict(spark, d):
    terms = load(spark, d, "events").select(F.col("event_id").alias("idx"), F.floor(F.col("event_id") / 70).alias("term"))
    return log.find_conflict(terms, 377)


@query("SELECT min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM events")
def log_bounds(spark, d):
    return log.bounds(_log(spark, d))


# --- The write-ahead log ------------------------------------------------------------


@query("SELECT event_id AS idx FROM events WHERE event_id < 600 + (SELECT min(event_id) FROM events)")
def wal_gap(spark, d):
    """A record that is missing ends the log, though all that follow are intact."""
    events = load(spark, d, "events")
    first = events.agg(F.min("event_id").alias("m")).first().m
    payload, i = F.col("props").cast("binary"), F.col("event_id")
    held = events.filter(i != first + 600)
    records = held.select(F.floor(i / 250).alias("segment"), i.alias("offset"), i.alias("idx"), F.col("user_id").alias("term"), payload.alias("payload"), F.crc32(payload).alias("crc"))
    return wal.intact_prefix(records).select("idx")


@query("SELECT event_id AS idx, user_id AS term FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id % 997 = 0 AND event_id > 500)")
def wal_intact_prefix(spark, d):
    """Records with damaged checksums end the log."""
    damaged = (F.col("event_id") % 997 == 0) & (F.col("event_id") > 500)
    payload = F.col("props").cast("binary")
    records = load(spark, d, "events").select(F.lit(0).cast("long").alias("segment"), F.col("event_id").alias("offset"), F.col("event_id").alias("idx"), F.col("user_id").alias("term"), payload.alias("payload"), (F.crc32(payload) + damaged.cast("long")).alias("crc"))
    return wal.intact_prefix(records).select("idx", "term")


@query("""WITH r AS (SELECT event_id // 300 AS segment, event_id - (event_id // 300) * 40 AS idx, user_id AS term FROM events), s AS (SELECT segment, min(idx) AS first FROM r GROUP BY segment)
SELECT idx, term FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.segment > r.segment AND s.first <= r.idx)""")
def wal_replay(spark, d):
    """Append batches that overlap their predecessors replace their tails."""
    segment, payload = F.floor(F.col("event_id") / 300), F.col("props").cast("binary")
    records = load(spark, d, "events").select(segment.alias("segment"), F.col("event_id").alias("offset"), (F.col("event_id") - segment * 40).alias("idx"), F.col("user_id").alias("term"), payload.alias("payload"), F.crc32(payload).alias("crc"))
    return wal.replay(records).select("idx", "term")


@query("SELECT max(event_id) AS idx FROM events WHERE event_type = 'signup' AND event_id % 3 <> 0")
def snapshot_newest_intact(spark, d):
    payload = F.col("props").cast("binary")
    snapshots = load(spark, d, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("idx"), payload.alias("payload"), (F.crc32(payload) + (F.col("event_id") % 3 == 0).cast("long")).alias("crc"))
    return wal.newest_intact(snapshots).select("idx")


@query("SELECT event_id AS idx FROM events WHERE event_type = 'signup' ORDER BY event_id DESC LIMIT 3")
def snapshot_retained(spark, d):
    return wal.retained(load(spark, d, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("idx")))


# --- Invariants: violations in logs that events make up -----------------------------------


@query("SELECT event_id // 3 AS term, count(DISTINCT user_id % 5) AS leaders FROM events WHERE event_type = 'signup' GROUP BY term HAVING count(DISTINCT user_id % 5) > 1")
def invariant_election_safety(spark, d):
    leaders = load(spark, d, "events").filter("event_type = 'signup'").select(F.floor(F.col("event_id") / 3).alias("term"), (F.col("user_id") % 5).alias("node"))
    return invariants.election_safety(leaders)


@query("""WITH a AS (SELECT user_id AS node, event_id AS seq, event_id - (event_id % 11) * 30 AS idx FROM events), b AS (SELECT *, lag(idx) OVER (PARTITION BY node ORDER BY seq) AS before FROM a)
SELECT node, seq, idx FROM b WHERE idx <= before""")
def invariant_append_only(spark, d):
    i = F.col("event_id")
    return invariants.append_only(load(spark, d, "events").select(F.col("user_id").alias("node"), i.alias("seq"), (i - (i % 11) * 30).alias("idx")))


def _replicas(spark, d) -> DataFrame:
    """Three replicas of one log; the third has other data at some entries."""
    i, node = F.col("event_id"), F.explode(F.array(*[F.lit(n).cast("long") for n in (0, 1, 2)])).alias("node")
    rows = load(spark, d, "events").select(node, i.alias("idx"), F.floor(i / 10).alias("term"), F.col("event_type").alias("data"))
    odd = (F.col("node") == 2) & (F.col("idx") % 113 == 0)
    return rows.withColumn("data", F.when(odd, F.lit("other")).otherwise(F.col("data")))


@query("SELECT a, 2::BIGINT AS b, event_id AS idx FROM events, (VALUES (0::BIGINT), (1::BIGINT)) t(a) WHERE event_id % 113 = 0")
def invariant_log_matching(spark, d):
    return invariants.log_matching(_replicas(spark, d))


@query("SELECT event_id AS idx, 2::BIGINT AS entries FROM events WHERE event_id % 113 = 0")
def invariant_state_machine_safety(spark, d):
    return invariants.state_machine_safety(_replicas(spark, d))


@query("SELECT user_id AS node, max(event_id) AS applied, max(CASE WHEN event_type <> 'error' THEN event_id END) AS commit FROM events GROUP BY user_id HAVING max(event_id) > max(CASE WHEN event_type <> 'error' THEN event_id END)")
def invariant_applied_committed(spark, d):
    status = load(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.max("event_id").alias("applied"), F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("commit"))
    return order_by(invariants.applied_committed(status), ("node", True))


# --- Streams ----------------------------------------------------------------------------------

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, d) -> DataFrame:
    return spark.readStream.schema(_EVENTS).parquet(f"{d}/events.parque[t]")  # a pattern, as the table may be one file


@query(_COMMANDS + _fold().replace("NOT replayed AND ", "") + "SELECT key, value FROM s WHERE value IS NOT NULL")
def stream_kv_fold(spark, d):
    """The keyed fold as a stream, with no replays to drop."""
    updates = stream.run_to_files(stream.fold_state(_commands(_stream(spark, d))), ["key"])
    return updates.filter("exists").select("key", "value")


@query(_COMMANDS + _fold() + "SELECT key, value FROM s WHERE value IS NOT NULL")
def stream_kv_state(spark, d):
    """Replay protection and the keyed fold, one stream after the other."""
    return stream.fold_once(_commands(_stream(spark, d))).filter("exists").select("key", "value")


@query(_COMMANDS + "SELECT idx, client_id, request_id FROM m WHERE NOT replayed")
def stream_drop_replays(spark, d):
    return stream.fresh(_commands(_stream(spark, d))).select("idx", "client_id", "request_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling_window(spark, d):
    windows = stream.run_to_files(stream.tumbling(_stream(spark, d)), ["start", "event_type"])
    return windows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
