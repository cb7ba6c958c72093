"""Training texts of recorded steps, code assignments and entities; answers to probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semid.functions.vectors import let

# The lines of a state block and what stands around the blocks.
STATE_OPEN, STATE_CLOSE = "<GAME_STATE>", "</GAME_STATE>"
STATE_LINES = ["  Season: ", "  Colonists: ", "  Resources: ", "  Research: ", "  Active Quests: ", "  Visible entities: ", "  Threats: "]
NO_THREATS, UNNAMED = "None", "?"
ACTIONS_OPEN, ACTIONS_CLOSE = "<ACTIONS>", "</ACTIONS>"
SHOTS_OPEN, SHOT_BETWEEN, SHOTS_CLOSE = "<SCREENSHOTS>\n  <VISION_START>", "<FRAME_SEP>", "<VISION_END>\n</SCREENSHOTS>"
REASONING_OPEN, REASONING_CLOSE = "<REASONING>\n  ", "\n</REASONING>"
MOST_MEMBERS = 8
# The probes' questions.
PROBES = {
    "buildings_visible": "Which buildings are visible on screen? List their names.",
    "season": "What is the current season?",
    "colonist_activity": "Are the colonists idle, working, or fighting?",
    "threat_on_screen": "Is there a threat visible on screen? Answer yes or no.",
}

text_of = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
listed = lambda c, f, sep=", ": F.coalesce(F.array_join(F.transform(c, f), sep), F.lit(""))
percent = lambda c: F.concat((c * 100).cast("int").cast("string"), F.lit("%"))


def state_block(state: Column, visible: Column) -> Column:
    """A state and the visible entities' codes. Shares are whole percent and amounts whole numbers, cut off, not rounded; maps come in their own order; a state without threats says so."""
    people = listed(state["colonists"], lambda c: F.concat(text_of(c["name"]), F.lit(" ("), text_of(c["job"]), F.lit(", mood "), percent(c["mood"]), F.lit(")")))
    goods = listed(F.map_entries(state["resources"]), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("bigint").cast("string")))
    research = listed(F.map_entries(state["research_progress"]), lambda e: F.concat(e["key"], F.lit(" "), percent(e["value"])))
    quests = listed(state["quests_active"], lambda q: F.concat(text_of(q["name"]), F.lit(" ("), text_of(q["progress"]), F.lit(")")))
    threats = listed(state["threats"], lambda t: F.coalesce(t["name"], F.lit(UNNAMED)))
    values = [F.concat(state["season"], F.lit(", Day "), state["day"].cast("string")), people, goods, research, quests, F.coalesce(F.array_join(visible, " "), F.lit("")), F.when(threats == "", NO_THREATS).otherwise(threats)]
    lines = [F.concat(F.lit(name), value) for name, value in zip(STATE_LINES, values, strict=True)]
    return F.concat_ws("\n", F.lit(STATE_OPEN), *lines, F.lit(STATE_CLOSE))


def actions_block(actions: Column) -> Column:
    """All actions, numbered from 1, with their parameters and reasons."""

    def line(a: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        params = listed(F.map_entries(a["params"]), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return F.concat(F.lit("  <ACTION_"), n, F.lit(">"), a["action"], F.lit("("), params, F.lit(") — "), F.coalesce(a["reason"], F.lit("")), F.lit("</ACTION_"), n, F.lit(">"))

    lines = F.transform(F.coalesce(actions, F.array().cast("array<struct<action: string, params: map<string, string>, reason: string>>")), line)
    return F.array_join(F.concat(F.array(F.lit(ACTIONS_OPEN)), lines, F.array(F.lit(ACTIONS_CLOSE))), "\n")


def reasoning_block(reasoning: Column) -> Column:
    return F.concat(F.lit(REASONING_OPEN), F.coalesce(reasoning, F.lit("")), F.lit(REASONING_CLOSE))


def screenshots_block(paths: Column) -> Column:
    """The file names of a step's pictures."""
    return F.concat(F.lit(SHOTS_OPEN), listed(paths, lambda p: F.regexp_extract(p, "[^/]*$", 0), SHOT_BETWEEN), F.lit(SHOTS_CLOSE))


def replay(step: Column) -> Column:
    """State, pictures, reasoning and actions of a step (of the schema ``STEP``)."""
    return F.concat_ws("\n", state_block(step["game_state"], step["visible_sids"]), screenshots_block(step["screenshots"]), reasoning_block(step["reasoning"]), actions_block(step["actions"]))


def action_prediction(step: Column) -> Column:
    """Actions from the state alone."""
    return F.concat_ws("\n", state_block(step["game_state"], step["visible_sids"]), actions_block(step["actions"]))


def reasoning_only(step: Column) -> Column:
    return F.concat_ws("\n", state_block(step["game_state"], step["visible_sids"]), reasoning_block(step["reasoning"]))


def entity_task(def_type: Column, name: Column, label: Column, sids: Column) -> Column:
    """From an entity to its codes."""
    return F.concat(def_type, F.lit(" "), name, F.lit(": "), F.coalesce(label, F.lit("")), F.lit(" -> "), sids)


def codes_task(sids: Column, name: Column, subcategory: Column, label: Column) -> Column:
    """From codes to their entity."""
    return F.concat(sids, F.lit(" -> "), F.concat_ws(", ", name, F.coalesce(subcategory, F.lit("")), F.coalesce(label, F.lit(""))))


def hierarchy_task(inline: Column, members: Column) -> Column:
    """The codes without their last level, and the first members below them."""
    before = F.when(F.contains(inline, F.lit("<SID_L")), F.regexp_extract(inline, "(?s)^(.*)<SID_L", 1)).otherwise("")
    return F.concat(before, F.lit("* members: "), F.array_join(F.slice(members, 1, MOST_MEMBERS), ", "))


def definition_blob(def_type: Column, name: Column, label: Column, description: Column, fields: Column) -> Column:
    """A definition as text to embed: type and name, label, description, then a line for each entry of the map ``fields``; what is empty is left out."""
    head = F.array(F.concat(def_type, F.lit(" "), name), F.coalesce(label, F.lit("")), F.coalesce(description, F.lit("")))
    lines = F.transform(F.coalesce(F.map_entries(fields), F.array().cast("array<struct<key: string, value: string>>")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    return F.array_join(F.filter(F.concat(head, lines), lambda x: x != ""), "\n")


def present(rows: DataFrame, names: str, index: DataFrame, key: str, none: int = 0) -> DataFrame:
    """(key, indexes): the sorted places in ``index`` (name, idx) of a row's ``names`` that it knows; ``none`` alone for rows without any."""
    asked = rows.select(key, F.explode(F.array_distinct(names)).alias("name")).join(index, "name").groupBy(key).agg(F.sort_array(F.collect_set("idx")).alias("indexes"))
    return rows.select(key).join(asked, key, "left").select(key, F.coalesce("indexes", F.array(F.lit(none))).alias("indexes"))


def answer_holds(probe: Column, answer: Column, season: Column, buildings: Column, jobs: Column, threats: Column) -> Column:
    """Whether an answer agrees with what is known, by the rule of its probe; of an unknown probe none does.

    The season must be named. Any building's name will do, or 'none' where there are none.
    Jobs other than 'idle' are work, and 'fighting' or a threat is a fight; that word must
    stand in the answer. A threat is answered by a 'yes', and none by no 'yes'. Case does not count.
    """
    empty = F.array().cast("array<string>")
    lower = lambda c: F.transform(F.coalesce(c, empty), lambda x: F.lower(F.coalesce(x, F.lit(""))))
    threatened = F.coalesce(F.size(threats), F.lit(0)) > 0

    def rules(a: Column) -> Column:
        seen, busy = lower(buildings), lower(jobs)
        label = F.when(F.array_contains(busy, "fighting") | threatened, "fighting").when(F.size(F.array_except(busy, F.array(F.lit("idle")))) > 0, "working").otherwise("idle")
        return (
            F.when(probe == "season", F.contains(a, F.lower(F.coalesce(season, F.lit("")))))
            .when(probe == "threat_on_screen", F.contains(a, F.lit("yes")) == threatened)
            .when(probe == "buildings_visible", F.when(F.size(seen) > 0, F.exists(seen, lambda n: F.contains(a, n))).otherwise(F.contains(a, F.lit("none"))))
            .when(probe == "colonist_activity", F.contains(a, label))
            .otherwise(False)
        )

    return let(F.lower(F.coalesce(answer, F.lit(""))), rules)


def probe_means(judged: DataFrame, probe: str = "probe", correct: str = "correct") -> DataFrame:
    """(probe, n, accuracy) for each of ``PROBES``, 0 for one that was not asked, and 'overall', the mean of these accuracies, each counting alike."""
    asked = judged.groupBy(probe).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy"))
    every = judged.sparkSession.createDataFrame([(p,) for p in PROBES], f"{probe} string")
    each = every.join(asked, probe, "left").select(probe, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
    return each.unionByName(each.agg(F.lit("overall").alias(probe), F.sum("n").alias("n"), F.avg("accuracy").alias("accuracy")))
