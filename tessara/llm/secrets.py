"""Secret scans: fixed patterns, plus character Markov models of random strings and ordinary identifiers.

Base spans come from three patterns.  In what they leave, tokens of 8 characters
or more that hold a digit or a change from lower to upper case are scored under
two first-order character models, one of random strings and one of ordinary
identifiers, both trained from labelled samples: a token's best stretch is the
run of transitions with the largest sum of log-likelihood ratios, each less a
toll, and it is a secret if that sum is over the log of the prior odds.  The toll ends a stretch where words begin, so words joined to a
random string neither hide it nor go with it.  Stretches under about twelve
characters may carry too little evidence, whatever they are.
Everything runs as DataFrame expressions.

Defined cases: null text is empty and has no spans; positions are code points,
ends exclusive; a document keeps its row, repeated rows too; a Markov span never
touches a base span; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A longer floor inside these two gives the same matches as dropping short ones afterwards:
#: in one run of their characters, the first match has the most characters after it.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Tokens under 8 characters, and words of letters without a change from lower to upper case, are not scored.
#: A match begins where its token does, so that each token is looked through once, however long.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9]|[A-Za-z+/_=-]*?[a-z][A-Z])[A-Za-z0-9+/_=-]{8,}"
KINDS = ["assign", "access", "hex", "markov"]
#: Documents that labelled samples are taken from: those with the smallest hashes of their id.
SAMPLE_DOCS = 4000
#: Log of the prior odds of an identifier against a secret; a token needs more evidence than this.
LOG_ODDS = 8.0
#: What each transition must add to lengthen a stretch.
TOLL = 0.5
_SYMBOLS = 128
_IDENTIFIERS = """get_user_account_settings_by_identifier createConnectionPoolManagerInstance
serialize_response_with_headers MAXIMUM_RETRY_ATTEMPTS_EXCEEDED application/vnd.openxmlformats
internationalization configuration-management-service handleAuthenticationCallback test_should_return_empty_list
lastModifiedTimestampInMillis data-processing-pipeline-runner parse_command_line_arguments
background-color-transition-duration AbstractSingletonProxyFactoryBean usr/local/share/applications
department_of_transportation_annual_report_2019 release_candidate_version_2_14_3 customer-relationship-management
node_modules/babel/core/lib/transformation index_documents_for_full_text_search""".split()


def _spans(text: Column, pattern: str, kind: int, part=None) -> Column:
    """array<struct(start, kind, end, found)> of the leftmost non-overlapping matches.

    part: of a match, the struct(lo, hi) of what counts in it, or null; without it, all of it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern), 1, F.size(found))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")

    def add(acc, x):
        start = acc.at + F.length(x.p)
        span = F.struct((start + x.c.lo).alias("start"), F.lit(kind).alias("kind"), (start + x.c.hi).alias("end"), F.substring(x.m, x.c.lo + 1, x.c.hi - x.c.lo).alias("found"))
        return F.struct((start + F.length(x.m)).alias("at"), F.when(x.c.isNull(), acc.out).otherwise(F.concat(acc.out, F.array(span))).alias("out"))

    every = F.aggregate(
        F.zip_with(between, found, lambda p, m: F.struct(p.alias("p"), m.alias("m"), (part or _whole)(m).alias("c"))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        add,
        lambda acc: acc.out,
    )
    return F.when(text.rlike(pattern), every).otherwise(none)


def _whole(match: Column) -> Column:
    return F.struct(F.lit(0).alias("lo"), F.length(match).alias("hi"))


def base_spans(text: Column) -> Column:
    return F.concat(
        _spans(text, ASSIGN, 0, lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8, _whole(m))),
        _spans(text, ACCESS, 1),
        _spans(text, HEX, 2),
    )


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """token, label: 1 for random strings, 0 for ordinary identifiers.

    Random strings: what the base patterns find in a bounded sample of docs,
    and digests written in base 64 and hexadecimal.  Identifiers: the other
    words of those documents, alone and in neighbouring pairs joined as names
    are, a short list of programming identifiers, and long numbers.
    """
    ids = least_hashed(docs.select("doc_id"), "doc_id", sample_docs).distinct()
    text = docs.join(F.broadcast(ids), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    base = base_spans(F.col("text"))
    value = lambda s: F.when(s.kind == 0, F.regexp_extract(s.found, ASSIGN, 1)).otherwise(s.found)
    secrets = text.select(F.explode(F.transform(base, value)).alias("token"), F.lit(1).alias("label"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = text.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("token"), F.lit(0).alias("label"))
    names = text.select(F.regexp_extract_all(plain, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w")).filter(F.size("w") > 1)
    neighbours = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    a, b = F.col("p.a"), F.col("p.b")
    number = (F.col("i") * 7 % 100).cast("string")
    forms = [*(F.concat_ws(sign, a, b) for sign in "_-/="), F.concat(F.initcap(a), F.initcap(b)), F.concat(F.lower(a), F.initcap(b)), F.upper(F.concat_ws("_", a, b)), F.concat(a, number), F.concat(F.upper(F.substring(a, 1, 3)), F.initcap(b))]
    joined = F.coalesce(*(F.when(F.col("i") % len(forms) == k, f) for k, f in enumerate(forms)))
    names = names.select(F.posexplode(neighbours).alias("i", "p")).select(joined.alias("token"), F.lit(0).alias("label"))
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    random = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.lower(F.hex(digest))).otherwise(F.base64(digest)).alias("token"), F.lit(1).alias("label"))
    numbers = spark.range(8000).select(F.substring(F.abs(F.xxhash64("id")).cast("string"), F.lit(1), (8 + F.col("id") % 12).cast("int")).alias("token"), F.lit(0).alias("label"))
    listed = spark.range(40).select(F.explode(F.array(*map(F.lit, _IDENTIFIERS))).alias("token"), F.lit(0).alias("label"))
    return secrets.union(words).union(names).union(random).union(numbers).union(listed)


def train(samples: DataFrame, uniform: float = 0.05) -> list[float]:
    """Log-likelihood ratios of transitions, at 128 * from + to; samples(token, label).

    Each model mixes what it has seen with a share of `uniform` of all symbols,
    so that one unseen transition is never more than some evidence.
    Only counts per transition and label (at most 2 * 128 * 128 rows) reach the driver.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.ascii(F.substring("token", i, F.lit(1))) * _SYMBOLS + F.ascii(F.substring("token", i + 1, F.lit(1))))
    counts = (
        samples.filter((F.length("token") >= 2) & F.col("token").rlike(r"^[\x00-\x7F]+$"))
        .select("label", F.explode(pairs).alias("pair"))
        .groupBy("label", "pair")
        .count()
        .collect()
    )
    seen = {(r.label, r.pair): r["count"] for r in counts}
    symbols = re.findall(r"[A-Za-z0-9+/_=-]", "".join(map(chr, range(_SYMBOLS))))
    out = [0.0] * (_SYMBOLS * _SYMBOLS)
    for a in map(ord, symbols):
        total = [max(1, sum(seen.get((label, a * _SYMBOLS + ord(b)), 0) for b in symbols)) for label in (0, 1)]
        for b in map(ord, symbols):
            p = [(1 - uniform) * seen.get((label, a * _SYMBOLS + b), 0) / total[label] + uniform / len(symbols) for label in (0, 1)]
            out[a * _SYMBOLS + b] = round(math.log(p[1] / p[0]), 6)
    return out


def best_stretch(token: Column, model: list[float], log_odds: float = LOG_ODDS, toll: float = TOLL) -> Column:
    """struct(lo, hi): where the token's run of transitions with the largest sum of log ratios lies; null unless that is over log_odds."""
    weights = F.split(F.lit(",".join(str(round(w - toll, 6)) for w in model)), ",").cast("array<double>")  # folded into one literal
    codes = F.transform(F.slice(F.split(token, ""), F.lit(1), F.length(token)), F.ascii)
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(weights, a * _SYMBOLS + b))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("begin"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))

    def step(acc, w):
        begin = F.when(acc.sum > 0, acc.begin).otherwise(acc.at)
        now = F.greatest(acc.sum, F.lit(0.0)) + w
        more = now > acc.best
        return F.struct(
            (acc.at + 1).alias("at"), begin.alias("begin"), now.alias("sum"), F.greatest(acc.best, now).alias("best"),
            F.when(more, begin).otherwise(acc.lo).alias("lo"), F.when(more, acc.at + 2).otherwise(acc.hi).alias("hi"),
        )

    # The ends of a random string may speak against it, so the stretch takes in the letters and digits that touch it.
    left = lambda acc: F.length(F.regexp_extract(F.substring(token, F.lit(1), acc.lo), "[A-Za-z0-9]*$", 0))
    right = lambda acc: F.length(F.regexp_extract(F.substring(token, acc.hi + 1, F.length(token)), "^[A-Za-z0-9]*={0,2}", 0))
    whole = lambda acc: F.struct((acc.lo - left(acc)).alias("lo"), (acc.hi + right(acc)).alias("hi"))
    return F.aggregate(steps, zero, step, lambda acc: F.when(acc.best > log_odds, whole(acc)))


def _between(text: Column, spans: Column) -> tuple[Column, Column]:
    """What is left of text before, between and after the spans (sorted by start, overlaps merged), and the lengths of these merged spans."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)).end, F.lit(-1))
    pair = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    merged = F.aggregate(
        spans,
        none,
        lambda acc, s: F.when(F.size(acc) == 0, pair(s.start, s.end))
        .when(s.start < last(acc), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), pair(F.try_element_at(acc, F.lit(-1)).start, F.greatest(last(acc), s.end))))
        .otherwise(F.concat(acc, pair(s.start, s.end))),
    )
    ends, starts = F.concat(F.array(F.lit(0)), merged.end), F.concat(merged.start, F.array(F.lit(2**31 - 1)))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a))
    return pieces, F.transform(merged, lambda s: s.end - s.start)


def scan(docs: DataFrame, model: list[float], log_odds: float = LOG_ODDS) -> DataFrame:
    """All columns of docs but base and spans, with base and spans: arrays of struct(start, kind, end, found), sorted."""
    text = F.coalesce("text", F.lit(""))
    found = docs.drop("base", "spans").withColumn("base", F.array_sort(base_spans(text)))
    pieces, lengths = _between(text, F.col("base"))
    blank = F.array_join(F.zip_with(pieces, lengths, lambda p, n: F.concat(p, F.repeat(F.lit(" "), F.coalesce(n, F.lit(0))))), "")
    rest = F.when(F.size("base") == 0, text).otherwise(blank)
    extra = _spans(rest, CANDIDATE, 3, lambda m: best_stretch(m, model, log_odds))
    return found.withColumn("spans", F.array_sort(F.concat("base", extra)))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every (merged) span replaced by a mark; spans sorted by start."""
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(_between(text, spans)[0], mark))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """n_assign, n_access, n_hex, base_sha256 by Python's re; for tests."""
    text = text or ""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    n = [len(out)]
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        more = [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
        n.append(len(more))
        out += more
    line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    return (*n, hashlib.sha256(line.encode()).hexdigest())
