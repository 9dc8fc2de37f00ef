"""Source quality: blocked fetches, target health, checks, coverage, replacement addresses."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from awardlake import vocab
from awardlake.functions import points
from awardlake.functions.text import looks_undecoded


def _any(text, marks):
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def _outcome(kind, *signals):
    parts = [F.lit(s) if isinstance(s, str) else s for s in signals]
    listed = F.array(*parts) if parts else F.array().cast("array<string>")
    return F.struct(F.lit(kind).alias("block_type"), listed.alias("signals"))


def classify_fetch_blocks(fetch_log: DataFrame, min_shell_chars=vocab.MIN_BODY_CHARS) -> DataFrame:
    """Add ``block_type`` and ``signals`` to fetch attempts (status, headers, body, error_type, error)."""
    whole = F.coalesce("body", F.lit(""))
    header = lambda n: F.coalesce(
        F.try_element_at(F.transform_keys(F.coalesce("headers", F.expr("map()").cast("map<string,string>")), lambda k, v: F.lower(k)), F.lit(n)),
        F.lit(""),
    )
    read = fetch_log.withColumns(
        {
            "_b": F.lower(whole), "_len": F.length(whole),
            "_server": F.lower(header("server")), "_ray": header("cf-ray"), "_cookie": F.lower(header("set-cookie")),
        }
    ).withColumns({"_chal": _any(F.col("_b"), vocab.CHALLENGE_MARKS)})
    # an attempt without a status never got an answer
    b, status, text_len = F.col("_b"), F.coalesce("status", F.lit(0)), F.col("_len")
    status_sig = F.concat(F.lit("status:"), status.cast("string"))
    failed = F.col("error_type").isNotNull()
    error_sig = F.concat(F.lit("error:"), "error_type")
    tls_words = "ssl|tls|certificate|handshake"
    tls = F.lower("error_type").rlike(tls_words) | F.coalesce(F.lower("error").rlike(tls_words), F.lit(False))
    fronted = (F.col("_ray") != "") | F.contains("_server", F.lit("cloudflare"))
    fronted_block = fronted & (F.col("_chal") | status.isin(403, 503))
    front_sig = points.optional_flag(fronted & ~failed & (status != 429), "header:cloudflare")
    answered = status.isin(200, 0) & (text_len > 0)
    short_sig = F.concat(F.lit("short_body:"), text_len.cast("string"))
    chain = (
        F.when(failed & tls, _outcome("tls_or_fingerprint", error_sig, "tls_error"))
        .when(failed, _outcome("network", error_sig))
        .when(status == 429, _outcome("rate_limit_429", "status:429"))
        .when(fronted_block & _any(b, ("turnstile", "challenge")), _outcome("waf_cloudflare", "body:cf_challenge"))
        .when(fronted_block, _outcome("waf_cloudflare", "body_or_status:cf"))
        .when(
            F.contains("_server", F.lit("akamai")) | F.contains("_cookie", F.lit("akamai")) | F.contains("_cookie", F.lit("_abck")),
            _outcome("waf_akamai", "header:akamai"),
        )
        .when(
            F.contains("_server", F.lit("datadome")) | F.contains("_cookie", F.lit("datadome")) | F.contains(b, F.lit("datadome")),
            _outcome("waf_datadome", "header_or_body:datadome"),
        )
        .when(F.col("_chal"), _outcome("waf_cloudflare", "body:cloudflare_challenge"))
        .when(_any(b, vocab.CAPTCHA_MARKS), _outcome("captcha", "body:captcha"))
        .when(F.contains(b, F.lit("cdn-cgi")) & F.contains(b, F.lit("challenge")), _outcome("js_challenge", "body:js_challenge"))
        .when(looks_undecoded(whole), _outcome("undecoded", "body:undecoded"))
        .when((status == 403) & _any(b, vocab.SOFT_DENY_MARKS), _outcome("waf_akamai", "status:403", "body:akamai_ish"))
        .when(status == 403, _outcome("http_403", "status:403"))
        .when(status.isin(500, 502, 503, 504), _outcome("unknown", status_sig))
        .when(
            answered & (text_len < min_shell_chars) & _any(b, (*vocab.CHALLENGE_MARKS, "challenge", "captcha")),
            _outcome("js_challenge", short_sig, "short_challenge_crumb"),
        )
        .when(answered & (text_len < min_shell_chars), _outcome("short_shell", short_sig))
        .when(answered, _outcome("none"))
        .when((status == 0) & (text_len == 0), _outcome("network", "empty_network"))
        .otherwise(_outcome("unknown", status_sig))
    )
    return read.withColumn("_o", chain).select(
        *fetch_log.columns, "_o.block_type", F.concat(front_sig, "_o.signals").alias("signals")
    )


def fetch_chain_outcome(attempts: DataFrame, max_429_retries=2) -> DataFrame:
    """Per url the first successful attempt in chain order, else the last failure."""
    shown = F.struct("via", "status", "ok", "ord")
    per = attempts.groupBy("url").agg(
        F.min_by(shown, F.when(F.col("ok"), F.col("ord"))).alias("won"), F.max_by(shown, "ord").alias("last"),
        F.min(F.when(F.col("ok"), F.col("ord"))).alias("_won_at"),
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == 429).alias("rate_limited"),
    )
    final = F.coalesce("won", "last")
    return per.select(
        "url", final["via"].alias("via"), final["status"].alias("status"), final["ok"].alias("ok"), "attempts",
        F.col("rate_limited").cast("bigint").alias("retries"),
        (F.col("rate_limited") > max_429_retries).alias("retries_exhausted"),
    )


def target_health(probe_log: DataFrame, as_of, max_age_days=30, max_failures=3, max_selector_misses=2, targets: DataFrame = None) -> DataFrame:
    """Fold a probe log (name, checked_at, seq, status, parsed_rows) into the health of each target.

    With ``targets`` (name) every one of them has a row: one that was never probed is ``unchecked`` and
    due. A probe without a status counts as one that got no answer.

    A counter is the number of failing probes after the last probe that reset it. Two aggregations
    find it, with map-side combine, however many probes one target has; nothing is sorted.
    """
    probe_log = probe_log.withColumn("status", F.coalesce("status", F.lit(0)))
    status, rows = F.col("status"), F.col("parsed_rows")
    reachable = status.between(200, 399)
    when = F.struct("checked_at", "seq")
    marked = probe_log.select(
        "name", "status", "parsed_rows", "checked_at", "seq", reachable.alias("up"),
        (reachable & (rows > 0)).alias("read"), (reachable & (rows == 0)).alias("missed"),
    )
    last = marked.groupBy("name").agg(
        F.max(F.when(F.col("up"), when)).alias("_up_at"), F.max(F.when(F.col("read"), when)).alias("_read_at"),
        F.max_by(F.struct("status", "up", "parsed_rows", "checked_at"), when).alias("l"),
        F.count(F.lit(1)).alias("probes"),
    )
    after = lambda reset: F.col(reset).isNull() | (when > F.col(reset))
    counts = marked.where(~F.col("up") | F.coalesce("missed", F.lit(False))).join(last.select("name", "_up_at", "_read_at"), "name").groupBy("name").agg(
        F.count_if(~F.col("up") & after("_up_at")).alias("consecutive_failures"),
        F.count_if(F.coalesce("missed", F.lit(False)) & after("_read_at")).alias("selector_misses"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    dead = F.col("l.status").isin(404, 410)
    selector_ok = F.when(F.col("l.up"), F.col("l.parsed_rows") > 0)
    label = (
        F.when(dead, "rotted").when(F.col("l.status") == 0, "unreachable")
        .when(F.coalesce(~selector_ok, F.lit(False)), "selector_miss").otherwise("ok")
    )
    age = (F.unix_micros(points.instant(as_of)) - F.unix_micros(F.col("l.checked_at").cast("timestamp"))) / 86400e6
    folded = last.join(counts, "name", "left")
    never = F.col("probes").isNull()
    if targets is not None:
        folded = targets.select("name").distinct().join(folded, "name", "left")
    return folded.select(
        "name", zero("probes").alias("probes"), F.col("l.status").alias("last_status"), F.col("l.checked_at").alias("last_checked"),
        selector_ok.alias("selector_ok"), zero("consecutive_failures").alias("consecutive_failures"),
        zero("selector_misses").alias("selector_misses"), F.when(never, "unchecked").otherwise(label).alias("label"),
        (F.coalesce(dead, F.lit(False)) | (zero("consecutive_failures") >= max_failures) | (zero("selector_misses") >= max_selector_misses)).alias("rotted"),
        (never | (age > max_age_days)).alias("due"),
    )


TABLE_FORMATS = tuple(f for f in vocab.SOURCE_FORMATS if f.startswith("html"))


def diagnose_zero_rows(checked: DataFrame) -> DataFrame:
    """Add ``diagnosis`` to fetched targets whose parser gave no row (format, text, rows)."""
    html = F.col("format").isin(*TABLE_FORMATS)
    found = F.regexp_count(F.lower("text"), F.lit("<table"))
    cause = (
        F.when(html & looks_undecoded(F.col("text")), "undecoded body")
        .when(html & (found == 0), "no table in body")
        .when(F.col("format") == "html_table_destination", "no destination table")
        .when(F.col("format") == "html_table_zone_matrix", "no matrix under a cabin heading")
        .when(F.col("format") == "html_table_seasonal_zones", "no legend or zone caption")
        .when(html, "table titles do not match")
        .when(F.col("format") == "pdf", "no chart grid")
        .otherwise("no rows for this format")
    )
    return checked.withColumn("tables", F.when(html, found)).withColumn("diagnosis", F.when(F.col("rows") == 0, cause))


def check_targets(targets: DataFrame, docs: DataFrame, row_counts: DataFrame, resolved: DataFrame, strict=vocab.STRICT_PROGRAMS) -> DataFrame:
    """Funnel fetch -> body -> rows -> resolved probe, per target, with status ok, warn or fail.

    ``docs``: name, status, ok, via, text, block_type; ``row_counts``: name, rows; ``resolved``: name,
    format, probe_ord, route (``LAX->IST biz``), program, miles for probes that resolved.
    """
    first = resolved.groupBy("name").agg(
        F.min_by(F.struct("route", "program", "miles"), F.struct("probe_ord", "program")).alias("r")
    )
    joined = (
        targets.join(docs.select("name", "status", "ok", "via", "text", "block_type"), "name", "left")
        .join(row_counts.select("name", "rows"), "name", "left").join(first, "name", "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0)).cast("bigint"))
    )
    seen = diagnose_zero_rows(joined)
    length = F.length(F.coalesce("text", F.lit("")))
    award = F.col("provides") == "award"
    place = F.concat("r.route", F.lit(" "), F.col("r.miles").cast("string"), F.lit("mi ("), "r.program", F.lit(")"))
    step = (
        F.when(F.col("ok").isNull(), "no fetch").when(~F.col("ok"), "fetch failed")
        .when((F.col("rows") == 0) & (length < vocab.MIN_BODY_CHARS), "short body").when(F.col("rows") == 0, "no rows").when(award, "rows").when(F.col("r").isNull(), "unresolved").otherwise("resolved")
    )
    graded = seen.withColumn("step", step)
    state = (
        F.when(F.col("step").isin("rows", "resolved"), "ok").when((F.col("step") == "no rows") & award, "warn")
        .when((F.col("step") == "unresolved") & ~F.coalesce(F.col("program").isin(*strict), F.lit(False)), "warn").otherwise("fail")
    )
    counted = F.concat(F.col("rows").cast("string"), F.lit(" rows"))
    detail = (
        F.when(F.col("step") == "no fetch", "no response")
        .when(F.col("step") == "fetch failed", F.concat(F.lit("fetch failed with status "), F.col("status").cast("string")))
        .when(F.col("step") == "short body", F.concat(F.lit("body of only "), length.cast("string"), F.lit(" characters")))
        .when(F.col("step") == "no rows", F.concat(F.lit("0 rows: "), "diagnosis")).when(F.col("step") == "rows", counted)
        .when(F.col("step") == "unresolved", F.concat(counted, F.lit(", no probe route resolved")))
        .otherwise(F.concat(counted, F.lit(", "), place))
    )
    blocked = (
        F.when(F.col("step") == "no fetch", "unknown").when(F.col("step") == "fetch failed", F.coalesce("block_type", F.lit("unknown")))
        .when(F.col("step") == "short body", F.coalesce("block_type", F.lit("short_shell"))).otherwise(F.nullif("block_type", F.lit("none")))
    )
    return graded.select(
        "name", "url", "role", "format", "provides", "trust", "program", *(["ord"] if "ord" in targets.columns else []),
        state.alias("status"), detail.alias("detail"), "rows", F.when(F.col("step") == "resolved", place).alias("resolved"),
        blocked.alias("block_type"), F.lit(False).alias("reclassified"),
    )


def probe_routes(spark) -> DataFrame:
    """The fixed probe routes per source format, format-specific ones first."""
    def rows():
        for fmt in vocab.SOURCE_FORMATS:
            probes = list(dict.fromkeys([*vocab.FORMAT_PROBES.get(fmt, ()), *vocab.PROBE_ROUTES]))
            for i, (o, d, c) in enumerate(probes):
                yield fmt, i, o, d, c, f"{o}-{d}-{c}", f"{o}->{d} {vocab.CABIN_SHORT[c]}"

    return spark.createDataFrame(
        list(rows()), "format string, probe_ord int, origin string, dest string, cabin string, route_key string, route string"
    )


def reclassify_by_role(results: DataFrame) -> DataFrame:
    """A failing fallback only warns."""
    spare = (F.col("status") == "fail") & (F.col("role") == "fallback")
    return results.withColumns(
        {
            "reclassified": F.col("reclassified") | spare,
            "detail": F.when(spare, F.concat(F.lit("fallback of a working primary: "), "detail")).otherwise(F.col("detail")),
            "status": F.when(spare, "warn").otherwise(F.col("status")),
        }
    )


def program_coverage(results: DataFrame) -> DataFrame:
    """Per charted programme whether a primary source works, with its primaries and fallbacks."""
    charted = results.where((F.col("provides") == "chart") & F.coalesce(F.col("program") != "", F.lit(False)))
    entry = F.struct("ord", "name", "status", "detail")
    primary = F.col("role") == "primary"
    names = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(x["name"].alias("name"), x["status"].alias("status"), x["detail"].alias("detail")))
    return charted.groupBy("program").agg(
        F.min("ord").alias("first_seen"), F.max(primary & (F.col("status") == "ok")).alias("has_working_primary"),
        names(F.collect_list(F.when(primary, entry))).alias("primaries"), names(F.collect_list(F.when(~primary, entry))).alias("fallbacks"),
    )


def scrape_summary(results: DataFrame, programs: DataFrame) -> DataFrame:
    """One row of counts by role and status, and whether every programme has a working primary."""
    count = lambda role, status: F.count_if((F.col("role") == role) & (F.col("status") == status)).alias(f"{role}_{status}")
    left = results.agg(
        F.count(F.lit(1)).alias("total"), *[count("primary", s) for s in ("ok", "warn", "fail")], *[count("fallback", s) for s in ("ok", "warn")]
    )
    right = programs.agg(
        F.count(F.lit(1)).alias("programs"), F.coalesce(F.min("has_working_primary"), F.lit(True)).alias("all_primaries_ok")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def select_replacement_urls(health: DataFrame, candidates: DataFrame, search_log: DataFrame, as_of, min_rotted=1, ttl_days=7, trust=0.30):
    """(adoptions, rejected addresses) for rotted targets not searched within the TTL.

    ``candidates``: name, ord, url, status, ok, rows. The first candidate that answers and parses is
    adopted; those before it are rejected. Below ``min_rotted`` rotted targets nothing is done.
    """
    rotted = health.where("rotted").select("name")
    enough = rotted.agg(F.count(F.lit(1))).scalar() >= min_rotted
    since = points.instant(as_of) - F.make_dt_interval(days=F.lit(ttl_days))
    recent = search_log.where(F.col("searched_at") > since).select("name")
    due = rotted.join(recent, "name", "left_anti").where(enough)
    tried = candidates.join(due, "name", "left_semi")
    valid = F.col("ok") & ~F.col("status").isin(404, 410) & (F.col("rows") > 0)
    first = tried.where(valid).groupBy("name").agg(F.min("ord").alias("_first"), F.min_by("url", "ord").alias("url"))
    adoptions = first.select("name", "url", F.lit(trust).alias("trust"))
    rejected = tried.join(first.select("name", "_first"), "name", "left").where(
        F.col("_first").isNull() | (F.col("ord") < F.col("_first"))
    ).select("name", "url")
    return adoptions, rejected


def inventory_summary(targets: DataFrame, creators: DataFrame, providers: DataFrame, discovered: DataFrame, stale: DataFrame) -> DataFrame:
    """Counts (section, key, value): channels by kind, provider health, discovered rows by intake, stale programmes."""
    def section(df, name, key):
        return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("section"), "key", "value")

    channels = creators.select(F.explode(F.array_compact(F.array(F.when(F.col("has_blog"), F.lit("blog")), F.when(F.col("has_youtube"), F.lit("youtube"))))).alias("kind"))
    state = F.when(F.col("disabled"), "disabled").otherwise(F.col("health"))
    intake = F.coalesce(F.nullif(F.split_part(F.coalesce("source_name", F.lit("")), F.lit(":"), F.lit(1)), F.lit("")), F.lit("other"))
    parts = [
        section(targets, "targets", F.col("provides")), section(channels, "channels", F.col("kind")),
        section(providers, "providers", state), section(discovered, "discovered", intake), section(stale.select("program").distinct(), "stale", F.col("program")),
    ]
    return reduce(DataFrame.unionByName, parts)
