"""Recorded episodes: schemas, progress, rewards, the action grammar, summaries and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semid.functions.text import SID_IN_TEXT
from semid.functions.vectors import let
from semid.operators.sampling import placed

STATE = (
    "struct<colonists: array<struct<name: string, mood: double, health: double, job: string>>, resources: map<string, double>, research_progress: map<string, double>,"
    " threats: array<struct<name: string>>, quests_active: array<struct<name: string, progress: string>>, season: string, day: int, temperature: double, wealth: double>"
)
STEP = f"struct<step: int, game_tick: bigint, screenshots: array<string>, game_state: {STATE}, visible_sids: array<string>, reasoning: string, actions: array<struct<action: string, params: map<string, string>, reason: string>>, reward: map<string, double>>"
EPISODE = f"episode_id string, game_seed string, scenario string, difficulty string, total_steps int, total_reward double, steps array<{STEP}>"

#: Scores that are summed up together.
RANGE = 100_000

# Reward coefficients.
WEIGHTS = {
    "quest_progress": 2.0,
    "wealth": 0.001,
    "research": 1.5,
    "construction": 0.5,
    "mood": 1.0,
    "death": -10.0,
    "idle": -0.1,
    "noop": -0.5,
    "invalid_action": -0.3,
}

# The actions, their kinds, keys or addresses, and parameters.
ACTIONS = [
    ("camera_pan_left", "key", "A", []),
    ("camera_pan_right", "key", "D", []),
    ("camera_pan_up", "key", "W", []),
    ("camera_pan_down", "key", "S", []),
    ("camera_zoom_in", "key", "ScrollUp", []),
    ("camera_zoom_out", "key", "ScrollDown", []),
    ("speed_pause", "key", "Space", []),
    ("speed_1x", "key", "1", []),
    ("speed_2x", "key", "2", []),
    ("speed_3x", "key", "3", []),
    ("select_at", "click", None, ["x", "y"]),
    ("right_click_at", "rclick", None, ["x", "y"]),
    ("drag_select", "drag", None, ["x1", "y1", "x2", "y2"]),
    ("menu_architect", "key", "F1", []),
    ("menu_orders", "submenu", ["Architect", "Orders"], []),
    ("menu_zone", "submenu", ["Architect", "Zone"], []),
    ("menu_structure", "submenu", ["Architect", "Structure"], []),
    ("menu_production", "submenu", ["Architect", "Production"], []),
    ("menu_furniture", "submenu", ["Architect", "Furniture"], []),
    ("menu_power", "submenu", ["Architect", "Power"], []),
    ("menu_security", "submenu", ["Architect", "Security"], []),
    ("menu_research", "key", "F2", []),
    ("menu_work", "key", "F3", []),
    ("increase_priority", "api", "/work/priority", ["pawn", "work_type", "delta"]),
    ("decrease_priority", "api", "/work/priority", ["pawn", "work_type", "delta"]),
    ("order_build", "api", "/build", ["def_name", "x", "y"]),
    ("order_mine", "api", "/designate", ["x", "y", "type"]),
    ("order_cut", "api", "/designate", ["x", "y", "type"]),
    ("order_hunt", "api", "/designate", ["x", "y", "type"]),
    ("order_research", "api", "/research/set", ["project_def"]),
    ("draft_pawn", "api", "/pawn/draft", ["pawn_id"]),
    ("undraft_pawn", "api", "/pawn/undraft", ["pawn_id"]),
    ("create_stockpile", "api", "/zone/create", ["type", "x1", "y1", "x2", "y2"]),
    ("create_growing_zone", "api", "/zone/create", ["type", "x1", "y1", "x2", "y2", "plant_def"]),
    ("wait", "noop", None, []),
    ("open_tab", "key", "Tab", []),
]
MOST_ACTIONS = 5
ACTION_BLOCK, ACTION_NAME, ACTION_PARAM, ACTION_REASON = "(?s)<ACTION_START>.*?<ACTION_END>", "<ACT:([^>]+)>", "<PARAM:([^=>]+)=([^>]*)>", "(?s)<REASON>(.*?)</REASON>"


def catalogue(spark: SparkSession) -> DataFrame:
    """(action, type, target, params): a few dozen rows."""
    rows = [(a, t, where if isinstance(where, list) else [] if where is None else [where], p) for a, t, where, p in ACTIONS]
    return spark.createDataFrame(rows, "action string, type string, target array<string>, params array<string>")


def special_tokens() -> list[str]:
    return ["<ACTION_START>", "<ACTION_END>", "<REASON>", "</REASON>", *[f"<ACT:{a[0]}>" for a in ACTIONS]]


def key_map() -> dict[str, str]:
    return {a: k for a, t, k, _ in ACTIONS if t == "key"}


def parse_progress(value: Column) -> Column:
    """Progress as a fraction: a number or percentage is clamped to [0, 1], ``a/b`` is not, anything else is 0."""
    s = F.trim(value.cast("string"))
    clamp = lambda x: F.when(x.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    fraction = "^\\s*(\\d+(?:\\.\\d+)?)\\s*/\\s*(\\d+(?:\\.\\d+)?)\\s*$"
    a, b = (F.regexp_extract(s, fraction, i).try_cast("double") for i in (1, 2))
    return F.when(s.endswith("%"), clamp(F.substring(s, F.lit(1), F.length(s) - 1).try_cast("double") / 100)).when(s.rlike(fraction), F.when(b != 0, a / b).otherwise(0.0)).otherwise(clamp(s.try_cast("double")))


def random_actions(key: Column, seed: int = 0) -> Column:
    """One to ``MOST_ACTIONS`` actions by hash draws of the key, none of which needs a place on the screen."""
    names = [a[0] for a in ACTIONS if a[0] not in ("select_at", "drag_select")]
    draw = lambda j, n: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), j)), 1, 12), 16, 10).cast("bigint"), F.lit(n)).cast("int")
    return F.transform(F.sequence(F.lit(0), draw(F.lit("n"), MOST_ACTIONS)), lambda j: F.get(F.array(*map(F.lit, names)), draw(j.cast("string"), len(names))))


def total_of(values: Column) -> Column:
    return F.aggregate(F.coalesce(values, F.array().cast("array<double>")), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def average_mood(state: Column) -> Column:
    n = F.size(F.coalesce(state["colonists"], F.array()))
    return F.when(n > 0, total_of(F.transform(state["colonists"], lambda c: c["mood"])) / n).otherwise(0.0)


def idle_count(state: Column) -> Column:
    return F.size(F.filter(F.coalesce(state["colonists"], F.array()), lambda c: F.lower(F.trim(F.coalesce(c["job"], F.lit("None")))).isin("idle", "", "none")))


def names_of(state: Column) -> Column:
    return F.transform(state["colonists"], lambda c: c["name"])


def deaths(before: Column, after: Column) -> Column:
    return F.size(F.array_except(names_of(before), names_of(after)))


def is_terminal(state: Column) -> Column:
    return F.size(F.coalesce(state["colonists"], F.array())) == 0


def quest_delta(before: Column, after: Column) -> Column:
    """Progress of the current quests beyond what the quest of that name had (0 for new ones)."""

    def had(name: Column) -> Column:
        same = F.filter(before["quests_active"], lambda q: q["name"] == name)
        return F.coalesce(parse_progress(F.get(same, F.size(same) - 1)["progress"]), F.lit(0.0))

    # Of quests of one name the last one counts.
    last = F.filter(after["quests_active"], lambda q, i: ~F.exists(F.slice(after["quests_active"], i + 2, F.size(after["quests_active"]) + 1), lambda r: r["name"].eqNullSafe(q["name"])))
    named = F.filter(last, lambda q: F.coalesce(q["name"], F.lit("")) != "")
    return total_of(F.transform(named, lambda q: parse_progress(q["progress"]) - had(q["name"])))


def reward(before: Column, after: Column, actions: Column, invalid: Column | None = None, weights: dict[str, float] | None = None) -> Column:
    """A struct of the reward's parts and their ``total``, which leaves out ``resource_delta``. ``actions`` is an array with a field ``action``."""
    w = WEIGHTS | (weights or {})
    buildings = lambda s: F.coalesce(F.try_element_at(s["resources"], F.lit("buildings")), F.lit(0.0)).cast("int")
    all_wait = (F.size(actions) > 0) & F.forall(actions, lambda a: a["action"] == "wait")
    parts = {
        "quest_progress": quest_delta(before, after) * w["quest_progress"],
        "wealth_delta": (after["wealth"] - before["wealth"]) * w["wealth"],
        "research_progress": (total_of(F.map_values(after["research_progress"])) - total_of(F.map_values(before["research_progress"]))) * w["research"],
        "construction_progress": F.greatest(F.lit(0), buildings(after) - buildings(before)) * w["construction"],
        "colonist_mood_delta": (average_mood(after) - average_mood(before)) * w["mood"],
        "death_penalty": deaths(before, after) * w["death"],
        "idle_penalty": idle_count(after) * w["idle"],
        "invalid_action_penalty": (F.lit(0) if invalid is None else invalid) * w["invalid_action"],
        "noop_penalty": F.when(all_wait, w["noop"]).otherwise(0.0),
    }
    resource = total_of(F.map_values(after["resources"])) - total_of(F.map_values(before["resources"]))
    total = sum(parts.values(), F.lit(0.0))
    return F.struct(*[c.cast("double").alias(n) for n, c in parts.items()], resource.alias("resource_delta"), total.cast("double").alias("total"))


def step_rewards(steps: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``breakdown`` for every step but the first of an episode. A step stores the state before its action, so its reward compares it with the next step's state; ``steps`` is (episode_id, step, state, actions)."""
    own = Window.partitionBy("episode_id").orderBy("step")
    ahead = steps.withColumn("_next", F.lead("state").over(own)).where("_next is not null")
    return ahead.withColumn("breakdown", reward(F.col("state"), F.col("_next"), F.col("actions"), None, weights)).drop("_next")


def explode_steps(episodes: DataFrame) -> DataFrame:
    return episodes.select("episode_id", F.explode("steps").alias("s")).select("episode_id", F.col("s.step").alias("step"), F.col("s.game_state").alias("state"), F.col("s.actions").alias("actions"), F.col("s.reward").alias("reward"))


def episode_summary(steps: DataFrame) -> DataFrame:
    """One row an episode: days, quests, wealth, deaths, reward, steps. ``steps`` is (episode_id, step, state, reward)."""
    own = Window.partitionBy("episode_id").orderBy("step")
    x = steps.withColumn("_deaths", F.coalesce(deaths(F.lag("state").over(own), F.col("state")), F.lit(0)))
    out = x.groupBy("episode_id").agg(F.max_by("state", "step").alias("last"), F.sum("_deaths").alias("deaths"), F.sum(F.coalesce(F.try_element_at("reward", F.lit("total")), F.lit(0.0))).alias("total_reward"), F.count("*").alias("steps"))
    quests = F.coalesce(F.col("last.quests_active"), F.array().cast("array<struct<name: string, progress: string>>"))
    done = F.size(F.filter(quests, lambda q: parse_progress(q["progress"]) >= 1.0))
    rate = F.when(F.size(quests) > 0, done / F.size(quests)).otherwise(0.0)
    return out.select("episode_id", F.col("last.day").alias("survival_days"), done.alias("quests_completed"), F.size(quests).alias("quests_total"), rate.alias("quest_completion_rate"), F.col("last.wealth").alias("final_wealth"), "deaths", "total_reward", "steps")


def episode_aggregate(summaries: DataFrame) -> DataFrame:
    return summaries.agg(
        F.count("*").alias("episodes"), F.avg("survival_days").alias("mean_survival_days"), F.avg("quest_completion_rate").alias("mean_quest_completion"),
        F.avg("final_wealth").alias("mean_final_wealth"), F.avg("deaths").alias("death_rate"), F.avg("total_reward").alias("mean_reward"),
    )


def format_action(action: Column, params: Column, reason: Column) -> Column:
    """An action's block: its parameters in the catalogue's order (in their own where it names none), and its reason if it has one."""
    order = F.create_map(*[x for a, _, _, p in ACTIONS for x in (F.lit(a), F.array(*map(F.lit, p)).cast("array<string>"))])
    known = F.coalesce(F.try_element_at(order, action), F.array().cast("array<string>"))
    keys = F.when(F.size(known) > 0, known).otherwise(F.map_keys(params))
    held = F.filter(keys, lambda k: F.map_contains_key(params, k))
    lines = F.concat(
        F.array(F.lit("<ACTION_START>"), F.concat(F.lit("<ACT:"), action, F.lit(">"))),
        F.transform(held, lambda k: F.concat(F.lit("<PARAM:"), k, F.lit("="), F.try_element_at(params, k), F.lit(">"))),
        F.when(F.coalesce(reason, F.lit("")) != "", F.array(F.concat(F.lit("<REASON>"), reason, F.lit("</REASON>")))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("<ACTION_END>")),
    )
    return F.array_join(lines, "\n")


def format_actions(blocks: Column) -> Column:
    return F.array_join(F.slice(blocks, 1, MOST_ACTIONS), "\n")


def parse_actions(turns: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, action, params, reason) for every action block; of repeated parameters the last counts; a block without an action is an error."""
    blocks = turns.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(ACTION_BLOCK), F.lit(0))).alias("pos", "block"))
    names = lambda i: F.transform(F.regexp_extract_all("block", F.lit(ACTION_PARAM), F.lit(i)), lambda x: F.trim(x))

    def last_wins(keys: Column) -> Column:
        at = F.filter(F.transform(keys, lambda k, i: F.struct(i.alias("i"), k.alias("k"))), lambda x: ~F.array_contains(F.slice(keys, x["i"] + 2, F.size(keys) + 1), x["k"]))
        return F.map_from_entries(F.transform(at, lambda x: F.struct(x["k"], F.get(names(2), x["i"]))))

    action = F.when(F.col("block").rlike(ACTION_NAME), F.trim(F.regexp_extract("block", ACTION_NAME, 1))).otherwise(F.raise_error(F.lit("an action block names no action")))
    return blocks.select(key, "pos", action.alias("action"), let(names(1), last_wins).alias("params"), F.trim(F.regexp_extract("block", ACTION_REASON, 1)).alias("reason"))


def typed(value: Column) -> Column:
    """A struct of the value as integer, else number, else text."""
    i = value.try_cast("bigint")
    whole = value.rlike("^\\s*[+-]?\\d+\\s*$")
    return F.struct(F.when(whole, i).alias("i"), F.when(~whole, value.try_cast("double")).alias("f"), F.when(~whole & value.try_cast("double").isNull(), value).alias("s"))


def validity(actions: DataFrame) -> DataFrame:
    """Adds ``valid``: a known action with all its parameters. The catalogue, a few dozen rows, is broadcast."""
    known = catalogue(actions.sparkSession).select("action", F.col("params").alias("_required"))
    joined = actions.join(F.broadcast(known), "action", "left")
    return joined.withColumn("valid", F.col("_required").isNotNull() & (F.size(F.array_except(F.coalesce("_required", F.array().cast("array<string>")), F.map_keys("params"))) == 0)).drop("_required")


def planning_scores(turns: DataFrame, key: str, text: str) -> DataFrame:
    """Per turn: actions, valid ones, their share, whether there are one to five, the share with reasons, and whether the reasoning names codes."""
    acts = validity(parse_actions(turns, key, text)).groupBy(key).agg(F.count("*").alias("a"), F.count_if("valid").alias("v"), F.count_if(F.col("reason") != "").alias("r"))
    x = turns.select(key, text).join(acts, key, "left").fillna(0, ["a", "v", "r"])
    share = lambda c: F.when(F.col("a") > 0, F.col(c) / F.col("a")).otherwise(0.0)
    uses = F.substring_index(F.col(text), "<ACTION_START>", 1).rlike(SID_IN_TEXT)
    return x.select(key, F.col("a").alias("num_actions"), F.col("v").alias("num_valid"), share("v").alias("action_validity"), F.col("a").between(1, MOST_ACTIONS).alias("count_ok"), share("r").alias("reason_coverage"), uses.alias("uses_sid"))


def planning_aggregate(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("turns"), F.avg("action_validity").alias("mean_action_validity"), F.avg(F.col("count_ok").cast("int")).alias("count_compliance"), F.avg("reason_coverage").alias("mean_reason_coverage"), F.avg(F.col("uses_sid").cast("int")).alias("sid_usage_rate"))


def render_state(state: Column) -> Column:
    """A short text of a state: day, season, wealth, colonists with mood in whole percent, resources."""
    people = F.transform(state["colonists"], lambda c: F.concat(c["name"], F.lit(" mood="), (c["mood"] * 100).cast("int").cast("string"), F.lit("% job="), F.coalesce(c["job"], F.lit(""))))
    goods = F.transform(F.array_sort(F.map_entries(state["resources"])), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string")))
    return F.concat_ws("\n", F.concat(F.lit("Day "), state["day"].cast("string"), F.lit(" "), state["season"], F.lit(" wealth="), state["wealth"].cast("int").cast("string")), F.array_join(people, "; "), F.array_join(goods, ", "))


def self_play_metrics(episodes: DataFrame, score: str) -> DataFrame:
    """Mean, best, and the element n // 2 of the scores in descending order, found by counts: of each score, then of those above it."""
    held = episodes.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"))
    whole = episodes.agg(F.avg(score).alias("mean"), F.max(score).alias("best"), F.count(score).alias("n"))
    ranks = placed(held, [F.desc("s")], "place")
    upto = ranks.withColumn("range", F.floor((F.col("place") - 1) / RANGE))
    before = upto.groupBy("range").agg(F.sum("c").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "before")  # a row for each range
    last = F.col("before") + F.sum("c").over(Window.partitionBy("range").orderBy("place"))
    spread = upto.join(F.broadcast(before), "range").withColumn("last", last)
    middle = spread.crossJoin(F.broadcast(whole.select("n"))).where((F.col("last") > F.floor(F.col("n") / 2)) & (F.col("last") - F.col("c") <= F.floor(F.col("n") / 2))).agg(F.max("s").alias("middle"))
    return whole.crossJoin(F.broadcast(middle)).select("mean", "best", "middle")  # one row each
