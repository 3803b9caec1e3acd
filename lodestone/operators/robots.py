"""Robots rules as data, and the decision for a URL with the rule that made it.

Rules are rows of (host, agent, kind, pattern). Of the groups of a host the one named after the agent counts, else the one of `*`; in it the rule with
the longest pattern that matches the path and query decides, and ALLOW wins a tie. `*` in a pattern stands for anything, `$` at its end for the end.
Without a group, or without a rule that matches, the URL is allowed. An empty pattern matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as ux


def parsed(files: DataFrame) -> DataFrame:
    """(host, agent, kind, pattern) of robots files (host, body): lines of user-agent, allow and disallow; agents that follow one another share their rules."""
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), r"\r\n?|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    fields = F.filter(F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v"))), lambda f: f["k"].isin("user-agent", "allow", "disallow"))
    empty = F.from_json(F.lit('{"agents":[],"open":false,"rules":[]}'), "struct<agents:array<string>,open:boolean,rules:array<struct<agent:string,kind:string,pattern:string>>>")

    def step(s: Column, f: Column) -> Column:
        names = f["k"] == "user-agent"
        agents = F.when(names & s["open"], F.concat(s["agents"], F.array(F.lower(f["v"])))).when(names, F.array(F.lower(f["v"]))).otherwise(s["agents"])
        # a group without rules is one too: it allows everything
        rules = F.when(names, F.array(F.struct(F.lower(f["v"]).alias("agent"), F.lit("GROUP").alias("kind"), F.lit("").alias("pattern")))).otherwise(F.transform(s["agents"], lambda a: F.struct(a.alias("agent"), F.upper(f["k"]).alias("kind"), f["v"].alias("pattern"))))
        return F.struct(agents.alias("agents"), names.alias("open"), F.concat(s["rules"], rules).alias("rules"))

    return files.select(F.lower("host").alias("host"), F.explode(F.aggregate(fields, empty, step, lambda s: s["rules"])).alias("r")).select("host", "r.*")


def matches(path: Column, pattern: Column) -> Column:
    """Whether a pattern matches a path from its start."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    expression = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))
    return (pattern != "") & F.regexp(path, expression)


def decisions(pages: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """pages with robots_decision (ALLOWED, DISALLOWED, NO_RULES) and robots_rule; rules of a host are few and travel as one list each."""
    host, name = ux.host(F.col(url)), F.lit(agent.lower())
    own = rules.groupBy("host").agg(F.collect_list(F.struct("agent", "kind", "pattern")).alias("_rules")).withColumnRenamed("host", "_host")
    both = pages.withColumn("_h", host).join(own, F.col("_h") == F.col("_host"), "left")
    named = F.filter("_rules", lambda r: r["agent"] == name)
    group = F.when(F.size(named) > 0, named).otherwise(F.filter("_rules", lambda r: r["agent"] == "*"))
    tail = F.regexp_extract(F.regexp_replace(F.col(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    way = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    fitting = F.filter(group, lambda r: (r["kind"] != "GROUP") & matches(F.col("_way"), r["pattern"]))
    ranked = F.transform(fitting, lambda r: F.struct(F.length(r["pattern"]).alias("n"), (r["kind"] == "ALLOW").alias("allow"), r["pattern"].alias("pattern")))
    judged = both.withColumn("_way", way).withColumn("_best", F.array_max(ranked))
    decision = F.when(F.col("_rules").isNull() | (F.size(group) == 0), "NO_RULES").when(F.col("_best").isNull() | F.col("_best.allow"), "ALLOWED").otherwise("DISALLOWED")
    return judged.select(*pages.columns, decision.alias("robots_decision"), F.col("_best.pattern").alias("robots_rule"))
