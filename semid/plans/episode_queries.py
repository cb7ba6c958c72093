"""Queries over episodes. A user's events make an episode: each event is a step whose state comes from the events so far; conversations make turns of actions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from semid.functions import renderings as X
from semid.functions.text import sid_sequence
from semid.operators import episodes as E
from semid.operators.sampling import top_half
from semid.plans.common import joined, r6, table


def steps(spark, sf_dir):
    """(episode_id, step, state, actions, reward) of each user's events in order."""
    ev = table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = ev.withColumn("step", F.row_number().over(own) - 1)
    n, i = F.col("event_id") % 4, F.col("event_id")
    job = lambda k: F.when((i + k) % 5 == 0, F.lit("Idle")).when((i + k) % 5 == 1, F.lit("")).otherwise(F.col("event_type"))
    people = F.filter(F.array(*[F.struct(F.lit(f"p{k}").alias("name"), ((i + k) % 100 / 100.0).alias("mood"), F.lit(1.0).alias("health"), job(k).alias("job")) for k in range(4)]), lambda c: F.substring(c["name"], 2, 1).cast("int") <= n)
    progress = F.when(i % 3 == 0, F.concat((i % 5).cast("string"), F.lit("/4"))).when(i % 3 == 1, F.concat((i % 101).cast("string"), F.lit("%"))).otherwise(F.lit("0.5"))
    state = F.struct(
        people.alias("colonists"), F.create_map(F.lit("buildings"), (F.col("step") % 7).cast("double"), F.lit("wood"), (i % 50).cast("double")).alias("resources"),
        F.create_map(F.lit("a"), (F.col("step") * 0.25).cast("double")).alias("research_progress"), F.array().cast("array<struct<name: string>>").alias("threats"),
        F.array(F.struct(F.lit("q").alias("name"), progress.alias("progress"))).alias("quests_active"), F.lit("Spring").alias("season"),
        (F.col("step") + 1).cast("int").alias("day"), F.lit(20.0).alias("temperature"), F.col("value").alias("wealth"),
    )
    actions = F.array(F.struct(F.when(F.col("event_type") == "click", "wait").otherwise("order_mine").alias("action")))
    return x.select(F.col("user_id").cast("string").alias("episode_id"), "step", state.cast(E.STATE).alias("state"), actions.alias("actions"), F.create_map(F.lit("total"), F.col("value")).alias("reward"))


def reward_breakdown(spark, sf_dir):
    x = E.step_rewards(steps(spark, sf_dir).select("episode_id", "step", "state", "actions"))
    names = ["quest_progress", "wealth_delta", "research_progress", "construction_progress", "colonist_mood_delta", "death_penalty", "idle_penalty", "invalid_action_penalty", "noop_penalty", "resource_delta", "total"]
    return x.select("episode_id", "step", *[r6(F.col("breakdown")[n]).alias(n) for n in names])


def _summaries(spark, sf_dir):
    return E.episode_summary(steps(spark, sf_dir).select("episode_id", "step", "state", "reward"))


def episode_summary(spark, sf_dir):
    return _summaries(spark, sf_dir).select("episode_id", "survival_days", "quests_completed", "quests_total", r6("quest_completion_rate").alias("quest_completion_rate"), "final_wealth", "deaths", F.round("total_reward", 4).alias("total_reward"), "steps")


def episode_aggregate(spark, sf_dir):
    return E.episode_aggregate(_summaries(spark, sf_dir)).select("episodes", *[F.round(c, 4).alias(c) for c in ("mean_survival_days", "mean_quest_completion", "mean_final_wealth", "death_rate", "mean_reward")])


def deaths_anti_join(spark, sf_dir):
    own = Window.partitionBy("episode_id").orderBy("step")
    return steps(spark, sf_dir).select("episode_id", "step", F.coalesce(E.deaths(F.lag("state").over(own), F.col("state")), F.lit(0)).alias("deaths"))


def terminal_and_mood(spark, sf_dir):
    return steps(spark, sf_dir).select("episode_id", "step", E.is_terminal(F.col("state")).alias("terminal"), r6(E.average_mood(F.col("state"))).alias("mood"), E.idle_count(F.col("state")).alias("idle"))


def parse_progress(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 6 == 0, F.concat((e % 7).cast("string"), F.lit(" / "), (e % 4).cast("string"))).when(e % 6 == 1, F.concat((e % 150).cast("string"), F.lit("%"))).when(e % 6 == 2, F.concat(F.lit("-0."), (e % 10).cast("string"))).when(e % 6 == 3, F.lit("garbage")).when(e % 6 == 4, F.concat((e % 3).cast("string"), F.lit(".5"))).otherwise(F.lit("x%"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", "raw", r6(E.parse_progress(F.col("raw"))).alias("progress"))


def _turns(spark, sf_dir):
    """A reasoning line, then 0 to 6 action blocks, from a turn's numbers."""
    c = table(spark, sf_dir, "conversations")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)).cast("int")
    name = lambda i: F.get(F.array(F.lit("order_build"), F.lit("wait"), F.lit("fly"), F.lit("select_at")), F.pmod(F.col("turn") + i, F.lit(4)).cast("int"))
    params = lambda i: F.create_map(F.lit("def_name"), F.lit("Wall"), F.lit("x"), i.cast("string"), F.lit("y"), F.col("turn").cast("string"))
    reason = lambda i: F.when(i % 2 == 0, F.lit("why not")).otherwise("")
    blocks = F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: E.format_action(name(i), params(i), reason(i)))).otherwise(F.array().cast("array<string>"))
    says = F.when(F.col("turn") % 2 == 0, F.lit("Look at <SID_L1_07> now.\n")).otherwise("Nothing here.\n")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.concat(says, F.array_join(blocks, "\n")).alias("text"))


def action_roundtrip(spark, sf_dir):
    x = E.parse_actions(_turns(spark, sf_dir), "turn_id", "text")
    return x.select("turn_id", "pos", "action", F.try_element_at("params", F.lit("x")).alias("x"), F.size("params").alias("n_params"), E.typed(F.try_element_at("params", F.lit("y")))["i"].alias("y"), "reason")


def action_validity(spark, sf_dir):
    x = E.validity(E.parse_actions(_turns(spark, sf_dir), "turn_id", "text"))
    return x.groupBy("action").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


def planning_scores(spark, sf_dir):
    x = E.planning_scores(_turns(spark, sf_dir), "turn_id", "text")
    return x.select("turn_id", "num_actions", "num_valid", r6("action_validity").alias("action_validity"), "count_ok", r6("reason_coverage").alias("reason_coverage"), "uses_sid")


def planning_aggregate(spark, sf_dir):
    x = E.planning_aggregate(E.planning_scores(_turns(spark, sf_dir), "turn_id", "text"))
    return x.select("turns", *[r6(c).alias(c) for c in x.columns[1:]])


def action_catalogue(spark, sf_dir):
    return E.catalogue(spark).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.size("params")).alias("params"))


def top_half_episodes(spark, sf_dir):
    x = _summaries(spark, sf_dir).select("episode_id", F.round("total_reward", 4).alias("total_reward"))
    return top_half(x, "total_reward", "episode_id")


def render_state(spark, sf_dir):
    return steps(spark, sf_dir).select("episode_id", "step", F.md5(E.render_state(F.col("state"))).alias("digest"))


def self_play_metrics(spark, sf_dir):
    x = _summaries(spark, sf_dir).select(F.round("total_reward", 4).alias("r"))
    return E.self_play_metrics(x, "r").select(*[F.round(c, 4).alias(c) for c in ("mean", "best", "middle")])


def _recorded(spark, sf_dir):
    """Steps of the schema of episodes: the states of ``steps`` with threats, pictures, reasons and codes."""
    i = F.col("step")
    threats = F.when(i % 3 == 0, F.array(F.struct(F.lit("raid").alias("name")), F.struct(F.lit(None).cast("string").alias("name")))).otherwise(F.array().cast("array<struct<name: string>>"))
    step = F.struct(
        i.cast("int").alias("step"), i.cast("bigint").alias("game_tick"), F.transform(F.sequence(F.lit(0), i % 3), lambda k: F.concat(F.lit("runs/a/"), k.cast("string"), F.lit(".png"))).alias("screenshots"),
        F.col("state").withField("threats", threats).alias("game_state"), F.array(F.concat(F.lit("<SID_L1_0"), (i % 10).cast("string"), F.lit(">")), F.lit("<SID_L2_03>")).alias("visible_sids"),
        F.concat(F.lit("as of day "), i.cast("string")).alias("reasoning"),
        F.array(F.struct(F.lit("wait").alias("action"), F.create_map().cast("map<string,string>").alias("params"), F.lit("rest").alias("reason")), F.struct(F.lit("order_mine").alias("action"), F.create_map(F.lit("x"), i.cast("string"), F.lit("y"), F.lit("2")).alias("params"), F.lit(None).cast("string").alias("reason"))).alias("actions"),
        F.col("reward"),
    )
    return steps(spark, sf_dir).select("episode_id", "step", step.cast(E.STEP).alias("s"))


def step_renderings(spark, sf_dir):
    out = _recorded(spark, sf_dir)
    return out.select("episode_id", "step", *[F.md5(f(F.col("s"))).alias(f.__name__) for f in (X.replay, X.action_prediction, X.reasoning_only)])


def entity_renderings(spark, sf_dir):
    """Parts as entities, each below the codes of its size and number; its siblings are the parts of its brand, type and size."""
    p, code = table(spark, sf_dir, "part"), F.array((F.col("p_size") % 8).cast("int"), (F.col("p_partkey") % 8).cast("int"))
    rows = p.select("*", sid_sequence(code, 2, False).alias("sid"))
    near = rows.groupBy("p_brand", "p_size").agg(F.sort_array(F.collect_list(F.concat(F.lit("P"), F.col("p_partkey").cast("string")))).alias("members"))
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    blob = X.definition_blob(F.col("p_type"), name, F.col("p_name"), F.when(F.col("p_size") > 25, F.lit("large")), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")))
    tasks = [X.entity_task(F.col("p_type"), name, F.col("p_name"), F.col("sid")).alias("to_codes"), X.codes_task(F.col("sid"), name, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_name")).alias("to_entity")]
    return rows.join(near, ["p_brand", "p_size"]).select("p_partkey", *tasks, X.hierarchy_task(F.col("sid"), F.col("members")).alias("members"), blob.alias("blob"))


def probe_rules(spark, sf_dir):
    """Turns as answers to all probes, against seasons, jobs, buildings and threats that follow from their conversation."""
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id")
    known = c.select("text", F.get(F.array(*map(F.lit, ("the", "a", "winter", ""))), (k % 4).cast("int")).alias("season"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("role"), F.lit("And"))).alias("buildings"), F.array(F.when(k % 5 == 0, "Idle").when(k % 5 == 1, "fighting").otherwise("mining")).alias("jobs"), F.when(k % 7 == 0, F.array(F.lit("raid"))).otherwise(F.array().cast("array<string>")).alias("threats"))
    asked = known.select("*", F.explode(F.array(*map(F.lit, X.PROBES))).alias("probe"))
    answer = F.when(F.col("probe") == "colonist_activity", F.concat(F.col("text"), F.lit(" they are working"))).otherwise(F.col("text"))
    judged = asked.select("probe", X.answer_holds(F.col("probe"), answer, F.col("season"), F.col("buildings"), F.col("jobs"), F.col("threats")).alias("correct"))
    return X.probe_means(judged).select("probe", "n", r6("accuracy").alias("accuracy"))


def present_entities(spark, sf_dir):
    """Each order's part brands among those that are listed, by their number there."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().where("p_brand >= 'Brand#3'").select(F.col("p_brand").alias("name"), F.substring("p_brand", 7, 2).cast("int").alias("idx"))
    held = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_list("p_brand").alias("names"))
    return X.present(held, "names", brands, "l_orderkey").select("l_orderkey", joined("indexes").alias("indexes"))


NAMES = "step_renderings entity_renderings probe_rules present_entities reward_breakdown episode_summary episode_aggregate deaths_anti_join terminal_and_mood parse_progress action_roundtrip action_validity planning_scores planning_aggregate action_catalogue top_half_episodes render_state self_play_metrics".split()
QUERIES = {n: globals()[n] for n in NAMES}

STEPS = """s AS (SELECT CAST(user_id AS VARCHAR) AS episode_id, event_id AS i, event_type, value, CAST(row_number() OVER w - 1 AS INTEGER) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, list_transform(range(0, i % 4 + 1), lambda k: 'p' || k) AS names, list_sum(list_transform(range(0, i % 4 + 1), lambda k: ((i + k) % 100) / 100.0)) / (i % 4 + 1) AS mood,
  len(list_filter(range(0, i % 4 + 1), lambda k: (i + k) % 5 < 2)) AS idle,
  CASE i % 3 WHEN 0 THEN (i % 5) / 4.0 WHEN 1 THEN least(1.0, (i % 101) / 100.0) ELSE 0.5 END AS quest FROM s)"""
SUMMARY = f"""{STEPS}, l AS (SELECT *, coalesce(len(list_filter(lag(names) OVER w, lambda n: NOT list_contains(names, n))), 0) AS dead FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY step)),
m AS (SELECT episode_id, CAST(max(step) + 1 AS INTEGER) AS survival_days, CAST(CASE WHEN arg_max(quest, step) >= 1 THEN 1 ELSE 0 END AS INTEGER) AS quests_completed, arg_max(value, step) AS final_wealth, CAST(sum(dead) AS BIGINT) AS deaths, round(sum(value), 4) AS total_reward, sum(value) AS raw, count(*) AS steps FROM l GROUP BY episode_id)"""
PROG = "CASE event_id % 6 WHEN 0 THEN (event_id % 7) || ' / ' || (event_id % 4) WHEN 1 THEN (event_id % 150) || '%' WHEN 2 THEN '-0.' || (event_id % 10) WHEN 3 THEN 'garbage' WHEN 4 THEN (event_id % 3) || '.5' ELSE 'x%' END"
TURNS = """c AS (SELECT conv_id || '-' || turn AS turn_id, turn, (conv_id + turn) % 7 AS k FROM conversations),
b AS (SELECT turn_id, turn, unnest(range(1, k + 1)) AS i FROM c),
x AS (SELECT turn_id, turn, i, ['order_build', 'wait', 'fly', 'select_at'][(turn + i) % 4 + 1] AS action, CASE WHEN i % 2 = 0 THEN 'why not' ELSE '' END AS reason FROM b),
p AS (SELECT turn_id, turn % 2 = 0 AS uses_sid, CAST(k AS BIGINT) AS num_actions, (SELECT count(*) FROM x WHERE x.turn_id = c.turn_id AND action <> 'fly') AS num_valid, (SELECT count(*) FROM x WHERE x.turn_id = c.turn_id AND reason <> '') AS r FROM c),
q AS (SELECT turn_id, num_actions, num_valid, CASE WHEN num_actions > 0 THEN num_valid / num_actions ELSE 0.0 END AS action_validity, num_actions BETWEEN 1 AND 5 AS count_ok, CASE WHEN num_actions > 0 THEN r / num_actions ELSE 0.0 END AS reason_coverage, uses_sid FROM p)"""
PEOPLE = "array_to_string(list_transform(names, lambda n, j: n || ' (' || CASE (i + j - 1) % 5 WHEN 0 THEN 'Idle' WHEN 1 THEN '' ELSE event_type END || ', mood ' || CAST(trunc(CAST((i + j - 1) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) * 100) AS INTEGER) || '%)'), ', ')"
RENDERED = f"""{STEPS}, b AS (SELECT episode_id, step,
  '<GAME_STATE>' || chr(10) || '  Season: Spring, Day ' || (step + 1) || chr(10) || '  Colonists: ' || {PEOPLE} || chr(10) || '  Resources: buildings ' || (step % 7) || ', wood ' || (i % 50) || chr(10) ||
  '  Research: a ' || (step * 25) || '%' || chr(10) || '  Active Quests: q (' || CASE i % 3 WHEN 0 THEN (i % 5) || '/4' WHEN 1 THEN (i % 101) || '%' ELSE '0.5' END || ')' || chr(10) ||
  '  Visible entities: <SID_L1_0' || (step % 10) || '> <SID_L2_03>' || chr(10) || '  Threats: ' || CASE WHEN step % 3 = 0 THEN 'raid, ?' ELSE 'None' END || chr(10) || '</GAME_STATE>' AS st,
  '<SCREENSHOTS>' || chr(10) || '  <VISION_START>' || array_to_string(list_transform(range(step % 3 + 1), lambda k: k || '.png'), '<FRAME_SEP>') || '<VISION_END>' || chr(10) || '</SCREENSHOTS>' AS sh,
  '<REASONING>' || chr(10) || '  as of day ' || step || chr(10) || '</REASONING>' AS re,
  '<ACTIONS>' || chr(10) || '  <ACTION_1>wait() — rest</ACTION_1>' || chr(10) || '  <ACTION_2>order_mine(x=' || step || ', y=2) — </ACTION_2>' || chr(10) || '</ACTIONS>' AS ac FROM t)"""
CODE = "'<SID_L1_0' || (p_size % 8) || '><SID_L2_0' || (p_partkey % 8) || '>'"
ORACLES = {
    "step_renderings": f"WITH {RENDERED} SELECT episode_id, step, md5(concat_ws(chr(10), st, sh, re, ac)) AS replay, md5(concat_ws(chr(10), st, ac)) AS action_prediction, md5(concat_ws(chr(10), st, re)) AS reasoning_only FROM b",
    "entity_renderings": f"""WITH m AS (SELECT p_brand, p_size, list_sort(list('P' || p_partkey)) AS ms FROM part GROUP BY ALL)
        SELECT p_partkey, p_type || ' P' || p_partkey || ': ' || p_name || ' -> ' || {CODE} AS to_codes, {CODE} || ' -> P' || p_partkey || ', ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || ', ' || p_name AS to_entity,
          '<SID_L1_0' || (p_size % 8) || '>* members: ' || array_to_string(ms[1:8], ', ') AS members, p_type || ' P' || p_partkey || chr(10) || p_name || chr(10) || CASE WHEN p_size > 25 THEN 'large' || chr(10) ELSE '' END || 'brand: ' || p_brand || chr(10) || 'size: ' || p_size AS blob FROM part JOIN m USING (p_brand, p_size)""",
    "probe_rules": """WITH c AS (SELECT lower(coalesce(text, '')) AS a, conv_id AS k, role FROM conversations),
        j AS (SELECT 'season' AS probe, contains(a, ['the', 'a', 'winter', ''][k % 4 + 1]) AS ok FROM c UNION ALL SELECT 'threat_on_screen', contains(a, 'yes') = (k % 7 = 0) FROM c
          UNION ALL SELECT 'buildings_visible', CASE WHEN k % 3 = 0 THEN contains(a, 'none') ELSE contains(a, lower(role)) OR contains(a, 'and') END FROM c
          UNION ALL SELECT 'colonist_activity', contains(a || ' they are working', CASE WHEN k % 5 = 1 OR k % 7 = 0 THEN 'fighting' WHEN k % 5 = 0 THEN 'idle' ELSE 'working' END) FROM c),
        p AS (SELECT probe, count(*) AS n, avg(CAST(ok AS INTEGER)) AS acc FROM j GROUP BY probe)
        SELECT probe, n, round(acc, 6) AS accuracy FROM p UNION ALL SELECT 'overall', CAST(sum(n) AS BIGINT), round(avg(acc), 6) FROM p""",
    "present_entities": """WITH b AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(substr(p_brand, 7, 2) AS INTEGER)) FILTER (p_brand >= 'Brand#3')) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
        SELECT l_orderkey, CASE WHEN x IS NULL OR len(x) = 0 THEN '0' ELSE array_to_string(x, ',') END AS indexes FROM b""",
    "reward_breakdown": f"""WITH {STEPS}, n AS (SELECT *, lead(names) OVER w AS n2, lead(mood) OVER w AS m2, lead(idle) OVER w AS idle2, lead(quest) OVER w AS q2, lead(value) OVER w AS v2, lead(step) OVER w AS s2, lead(i) OVER w AS i2 FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY step)),
r AS (SELECT episode_id, step, 2.0 * (q2 - quest) AS quest_progress, (v2 - value) * 0.001 AS wealth_delta, 0.25 * 1.5 * (s2 - step) AS research_progress, greatest(0, s2 % 7 - step % 7) * 0.5 AS construction_progress, m2 - mood AS colonist_mood_delta, -10.0 * len(list_filter(names, lambda x: NOT list_contains(n2, x))) AS death_penalty, -0.1 * idle2 AS idle_penalty, 0.0 AS invalid_action_penalty, CASE WHEN event_type = 'click' THEN -0.5 ELSE 0.0 END AS noop_penalty, (s2 % 7 + i2 % 50 - step % 7 - i % 50) AS resource_delta FROM n WHERE n2 IS NOT NULL)
SELECT episode_id, step, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in ('quest_progress', 'wealth_delta', 'research_progress', 'construction_progress', 'colonist_mood_delta', 'death_penalty', 'idle_penalty', 'invalid_action_penalty', 'noop_penalty', 'resource_delta'))},
round(CAST(quest_progress AS DOUBLE) + wealth_delta + CAST(research_progress + construction_progress AS DOUBLE) + colonist_mood_delta + CAST(death_penalty + idle_penalty + noop_penalty AS DOUBLE), 6) AS total FROM r""",
    "episode_summary": f"WITH {SUMMARY} SELECT episode_id, survival_days, quests_completed, CAST(1 AS INTEGER) AS quests_total, CAST(quests_completed AS DOUBLE) AS quest_completion_rate, final_wealth, deaths, total_reward, steps FROM m",
    "episode_aggregate": f"WITH {SUMMARY} SELECT count(*) AS episodes, round(avg(survival_days), 4) AS mean_survival_days, round(avg(quests_completed), 4) AS mean_quest_completion, round(avg(final_wealth), 4) AS mean_final_wealth, round(avg(deaths), 4) AS death_rate, round(avg(raw), 4) AS mean_reward FROM m",
    "deaths_anti_join": f"WITH {STEPS} SELECT episode_id, step, CAST(coalesce(len(list_filter(lag(names) OVER w, lambda n: NOT list_contains(names, n))), 0) AS INTEGER) AS deaths FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY step)",
    "terminal_and_mood": f"WITH {STEPS} SELECT episode_id, step, false AS terminal, round(CAST(mood AS DOUBLE), 6) AS mood, CAST(idle AS INTEGER) AS idle FROM t",
    "parse_progress": f"SELECT event_id, {PROG} AS raw, round(CAST(CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 0 ELSE (event_id % 7) / (event_id % 4) END WHEN 1 THEN least(1, (event_id % 150) / 100) WHEN 4 THEN least(1, event_id % 3 + 0.5) ELSE 0 END AS DOUBLE), 6) AS progress FROM events",
    "action_roundtrip": f"WITH {TURNS} SELECT turn_id, CAST(i - 1 AS INTEGER) AS pos, action, CASE WHEN action IN ('order_build', 'select_at') OR action IN ('fly', 'wait') THEN CAST(i AS VARCHAR) END AS x, CAST(CASE action WHEN 'select_at' THEN 2 ELSE 3 END AS INTEGER) AS n_params, turn AS y, reason FROM x",
    "action_validity": f"WITH {TURNS} SELECT action, count(*) AS n, count(*) FILTER (action <> 'fly') AS valid FROM x GROUP BY action",
    "planning_scores": f"WITH {TURNS} SELECT turn_id, num_actions, num_valid, round(action_validity, 6) AS action_validity, count_ok, round(reason_coverage, 6) AS reason_coverage, uses_sid FROM q",
    "planning_aggregate": f"WITH {TURNS} SELECT count(*) AS turns, round(avg(action_validity), 6) AS mean_action_validity, round(avg(CAST(count_ok AS INTEGER)), 6) AS count_compliance, round(avg(reason_coverage), 6) AS mean_reason_coverage, round(avg(CAST(uses_sid AS INTEGER)), 6) AS sid_usage_rate FROM q",
    "top_half_episodes": f"WITH {SUMMARY} SELECT episode_id, total_reward FROM m ORDER BY total_reward DESC, episode_id LIMIT (SELECT greatest(1, count(*) // 2) FROM m)",
    "self_play_metrics": f"WITH {SUMMARY} SELECT round(avg(total_reward), 4) AS mean, round(max(total_reward), 4) AS best, round(list_sort(list(total_reward), 'DESC')[count(*) // 2 + 1], 4) AS middle FROM m",
    "render_state": f"""WITH {STEPS} SELECT episode_id, step, md5('Day ' || (step + 1) || ' Spring wealth=' || CAST(trunc(value) AS INTEGER) || chr(10) ||
array_to_string(list_transform(names, lambda n, j: n || ' mood=' || CAST(trunc(CAST((i + j - 1) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) * 100) AS INTEGER) || '% job=' || CASE (i + j - 1) % 5 WHEN 0 THEN 'Idle' WHEN 1 THEN '' ELSE event_type END), '; ') || chr(10) ||
'buildings=' || (step % 7) || ', wood=' || (i % 50)) AS digest FROM t""",
    "action_catalogue": "SELECT type, count(*) AS n, CAST(sum(p) AS BIGINT) AS params FROM (VALUES " + ", ".join(f"('{t}', {len(p)})" for _, t, _, p in E.ACTIONS) + ") v(type, p) GROUP BY type",
}
