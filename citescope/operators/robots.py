"""robots.txt permissions. One row per host goes in; everything up to the summary is row-local.

A file is cut into groups with array functions (a group starts at a user-agent line that does not
follow another one), so a host with a huge file never meets other hosts and nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import col, let, strip, text_or_empty


def robots_valid(status: Column | str, content_type: Column | str, body: Column | str) -> Column:
    """A real robots file: answered with 200, no HTML page, at least one user-agent line."""
    text = text_or_empty(body)
    html = text_or_empty(content_type).rlike("(?i)text/html") | text.rlike(r"(?i)^\s*<(?:!doctype|html)")
    return (F.coalesce(col(status), F.lit(0)) == 200) & ~html & text.rlike(r"(?i)user-agent\s*:")


def robots_lines(body: Column | str) -> Column:
    """array<struct<field, value>> of the lines that have a field, comments removed."""
    lines = F.transform(
        F.split(text_or_empty(body), r"\r?\n"), lambda x: strip(F.regexp_replace(x, "#.*$", ""))
    )
    shaped = F.filter(lines, lambda x: x.rlike(r"^[A-Za-z-]+\s*:"))
    return F.transform(
        shaped,
        lambda x: F.struct(
            F.lower(F.regexp_extract(x, r"^([A-Za-z-]+)\s*:", 1)).alias("field"),
            strip(F.regexp_extract(x, r"^[A-Za-z-]+\s*:(.*)$", 1)).alias("value"),
        ),
    )


def robots_groups(body: Column | str) -> Column:
    """array<struct<agents, rules array<struct<kind, path>>>>."""
    def cut(lines: Column) -> Column:
        marked = F.transform(
            lines,
            lambda x, i: F.struct(
                (i + 1).alias("at"),
                (
                    (x["field"] == "user-agent")
                    & ((i == 0) | (F.coalesce(F.get(lines, i - 1)["field"], F.lit("")) != "user-agent"))
                ).alias("opens"),
            ),
        )
        starts = F.transform(F.filter(marked, lambda m: m["opens"]), lambda m: m["at"])

        def group(all_starts: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(all_starts, k + 1), F.size(lines) + 1)
                part = F.slice(lines, start, stop - start)
                agents = F.filter(part, lambda x: x["field"] == "user-agent")
                rules = F.filter(part, lambda x: x["field"].isin("allow", "disallow"))
                return F.struct(
                    F.transform(agents, lambda x: F.lower(x["value"])).alias("agents"),
                    F.transform(
                        rules, lambda x: F.struct(x["field"].alias("kind"), x["value"].alias("path"))
                    ).alias("rules"),
                )

            return F.transform(all_starts, one)

        return let(starts, group)

    return let(robots_lines(body), cut)


def robots_rules(robots: DataFrame, host: str = "host") -> DataFrame:
    """E1 in relational form: one row per host, group and rule, with the agents of the group."""
    valid = robots.where(robots_valid("status", "content_type", "body"))
    groups = valid.select(host, F.posexplode(robots_groups("body")).alias("group_no", "g"))
    return groups.select(
        host, "group_no", F.col("g.agents").alias("agents"),
        F.posexplode_outer("g.rules").alias("rule_no", "r"),
    ).select(host, "group_no", "agents", "rule_no", F.col("r.kind").alias("kind"), F.col("r.path").alias("path"))


def rule_pattern(rule: Column) -> Column:
    """A rule as an anchored pattern: `*` is any text, `$` at the end is the end; all else literal."""
    ends = rule.endswith("$")
    body = F.when(ends, F.substring(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("(?s)^"), F.regexp_replace(escaped, r"\*", ".*"))
    return F.when(ends, F.concat(pattern, F.lit(r"\z"))).otherwise(pattern)


def rule_matches(rule: Column, path: Column) -> Column:
    """Does a rule cover a path? A rule without `*` and `$` is a prefix; an empty one never matches."""
    special = rule.contains("*") | rule.endswith("$")
    return (rule != "") & F.when(special, F.rlike(path, rule_pattern(rule))).otherwise(
        F.startswith(path, rule)
    )


def rules_for_bot(groups: Column, bot: Column) -> Column:
    """All rules of the groups naming the bot, else of the `*` groups; NULL if there are none."""
    own = F.filter(groups, lambda g: F.array_contains(g["agents"], F.lower(bot)))
    any_bot = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    chosen = F.when(F.size(own) > 0, own).when(F.size(any_bot) > 0, any_bot)
    return F.flatten(F.transform(chosen, lambda g: g["rules"]))


def path_allowed(rules: Column, path: Column) -> Column:
    """The longest matching rule wins, a tie allows, no rule allows."""
    def longest(kind: str) -> Column:
        hits = F.filter(rules, lambda r: (r["kind"] == kind) & rule_matches(r["path"], path))
        return F.coalesce(F.array_max(F.transform(hits, lambda r: F.length(r["path"]))), F.lit(-1))

    blocked = longest("disallow")
    return rules.isNull() | (blocked < 0) | (longest("allow") >= blocked)


def check_paths(requests: DataFrame, robots: DataFrame, host: str = "host") -> DataFrame:
    """E3 to E5 for requests (host, bot, path, ...): adds `allowed`. An equi join on host, no theta join."""
    groups = robots.select(
        host,
        F.when(
            robots_valid("status", "content_type", "body"), robots_groups("body")
        ).alias("_groups"),
    )
    joined = requests.join(groups, host, "left")
    allowed = let(
        rules_for_bot(F.col("_groups"), F.col("bot")), lambda r: path_allowed(r, F.col("path"))
    )
    return joined.withColumn("allowed", F.col("_groups").isNull() | allowed).drop("_groups")


def _rules_with_hits(groups: Column, paths: Sequence[str]) -> Column:
    """Groups whose rules carry their length and, per path, whether they match it."""
    def judged(r: Column) -> Column:
        return F.struct(
            (r["kind"] == "allow").alias("allow"),
            F.length(r["path"]).alias("size"),
            F.array(*[rule_matches(r["path"], F.lit(p)) for p in paths]).alias("hits"),
        )

    return F.transform(
        groups,
        lambda g: F.struct(g["agents"].alias("agents"), F.transform(g["rules"], judged).alias("rules")),
    )


def _bot_verdicts(groups: Column, bots: Sequence[tuple[str, str, str]], paths: Sequence[str]) -> Column:
    """array<struct<bot, category, root_blocked, paths>> for every known bot."""
    def verdict(token: Column, category: Column) -> Column:
        def closed(rules: Column) -> Column:
            def path_closed(i: int) -> Column:
                def longest(allow: bool) -> Column:
                    hits = F.filter(
                        rules, lambda r: (r["allow"] == F.lit(allow)) & F.get(r["hits"], F.lit(i))
                    )
                    return F.coalesce(F.array_max(F.transform(hits, lambda r: r["size"])), F.lit(-1))

                shut = longest(False)
                return F.coalesce((shut >= 0) & (longest(True) < shut), F.lit(False))

            return F.array(*[path_closed(i) for i in range(len(paths))])

        flags = let(rules_for_bot(groups, token), closed)
        return let(
            flags,
            lambda f: F.struct(
                token.alias("bot"), category.alias("category"), F.get(f, F.lit(0)).alias("root_blocked"),
                F.filter(
                    F.array(*[F.when(F.get(f, F.lit(i)), F.lit(p)) for i, p in enumerate(paths) if i]),
                    lambda p: p.isNotNull(),
                ).alias("paths"),
            ),
        )

    known = F.array(
        *[F.struct(F.lit(t).alias("token"), F.lit(c).alias("category")) for t, _, c in bots]
    )
    return F.transform(known, lambda b: verdict(b["token"], b["category"]))


def robots_summary(robots: DataFrame, host: str = "host") -> DataFrame:
    """One row per host with the blocked bots by purpose, partial blocks, sitemap and note."""
    valid = robots_valid("status", "content_type", "body")
    verdicts = let(
        _rules_with_hits(robots_groups("body"), K.EVIDENCE_PATHS),
        lambda g: _bot_verdicts(g, K.BOTS, K.EVIDENCE_PATHS),
    )
    judged = robots.select(
        host, valid.alias("present"), F.when(valid, verdicts).alias("_v"),
        F.when(valid, F.regexp_extract(col("body"), r"(?im)^\s*sitemap\s*:\s*(\S+)", 1)).alias("_map"),
    )

    def bots(test) -> Column:
        hits = F.transform(F.filter(F.col("_v"), test), lambda v: v["bot"])
        return F.coalesce(hits, F.array().cast("array<string>"))

    partial = F.coalesce(
        F.transform(
            F.filter(
                F.col("_v"),
                lambda v: ~v["root_blocked"] & (v["category"] == "citation") & (F.size(v["paths"]) > 0),
            ),
            lambda v: F.struct(v["bot"].alias("bot"), v["paths"].alias("paths")),
        ),
        F.array().cast("array<struct<bot:string,paths:array<string>>>"),
    )
    lists = judged.select(
        host, "present",
        bots(lambda v: v["root_blocked"]).alias("blocked_bots"),
        bots(lambda v: v["root_blocked"] & (v["category"] == "citation")).alias("blocked_citation"),
        bots(lambda v: v["root_blocked"] & (v["category"] == "training")).alias("blocked_training"),
        partial.alias("partial_blocks"),
        F.when(F.col("_map") != "", F.col("_map")).alias("sitemap"),
    )
    partial_text = F.array_join(
        F.transform(
            "partial_blocks",
            lambda p: F.concat(p["bot"], F.lit("("), F.array_join(p["paths"], " "), F.lit(")")),
        ),
        ", ",
    )
    note = (
        F.when(~F.col("present"), K.ROBOTS_ABSENT_NOTE)
        .when(
            F.size("blocked_citation") > 0,
            F.concat(F.lit(K.ROBOTS_CITATION_NOTE), F.array_join("blocked_citation", ", ")),
        )
        .when(F.size("partial_blocks") > 0, F.concat(F.lit(K.ROBOTS_PARTIAL_NOTE), partial_text))
        .when(
            F.size("blocked_training") > 0,
            F.concat(F.lit(K.ROBOTS_TRAINING_NOTE), F.array_join("blocked_training", ", ")),
        )
        .otherwise(K.ROBOTS_OPEN_NOTE)
    )
    return lists.select(
        "*", (F.size("blocked_citation") > 0).alias("blocks_any"), note.alias("note")
    )
