import math
import random
from datetime import datetime, timedelta

import pytest

from scriptoria.operators import planner as P
from scriptoria.operators.session import Settings, plan_sessions

ITEM = "learner long, item_id long, material_id long, sub_key string, state int, reps long, due timestamp_ntz, last_review timestamp_ntz, stability double, suspended boolean, buried_until timestamp_ntz"
NOW = datetime(2024, 3, 10, 9)
FAR = datetime(2024, 4, 1)


def frames(spark, items, materials, subjects, log=()):
    topics = sorted({(m[1], m[1] % max(1, len(subjects))) for m in materials})
    return (
        spark.createDataFrame(items, ITEM),
        spark.createDataFrame(materials, "material_id long, topic_id long, type string, status string, synthesis boolean, created_at long"),
        spark.createDataFrame([(t, s, t % 5 / 5, None) for t, s in topics], "topic_id long, subject_id long, exam_weight double, exam_weight_override double"),
        spark.createDataFrame([(i, *s[:2]) for i, s in enumerate(subjects)], "subject_id long, status string, daily_new_limit long"),
        spark.createDataFrame([(i, s[2]) for i, s in enumerate(subjects) if s[2]], "subject_id long, date date"),
        spark.createDataFrame(list(log), "log_id long, item_id long, ts timestamp_ntz, duration_ms long, counted boolean"),
    )


def new(learner, item, material, key="c1"):
    return (learner, item, material, key, 0, 0, None, None, 0.0, False, None)


def known(learner, item, material, due=NOW, state=2, buried=None, suspended=False):
    return (learner, item, material, "c1", state, 1, due, NOW - timedelta(days=3), 3.0, suspended, buried)


def run(spark, *args, settings=Settings(), now=NOW):
    plan = plan_sessions(*frames(spark, *args), now.isoformat(" "), settings)
    cards = sorted(plan.cards.collect(), key=lambda c: (c.learner, c.place))
    return cards, {r.learner: r for r in plan.summary.collect()}


def test_reviews_come_first_and_new_items_pause_while_some_wait(spark):
    materials = [(m, m, "qa", "active", False, m) for m in range(40)]
    items = [known(1, i, i) for i in range(20)] + [new(1, 100 + i, 20 + i) for i in range(10)] + [known(2, 200 + i, i) for i in range(3)] + [new(2, 300 + i, 20 + i) for i in range(10)] + [known(3, 400, 39, FAR)]
    cards, sums = run(spark, items, materials, [("active", None, None)], settings=Settings(daily_minutes=2, new_per_day=4))
    assert (sums[1].due_total, sums[1].due_included, sums[1].deferred, sums[1].new_included, sums[1].new_paused, sums[1].backlog_days) == (20, 10, 10, 0, True, 2)
    assert (sums[2].due_included, sums[2].new_included, sums[2].new_paused, sums[2].new_available) == (3, 4, False, 10)
    assert (sums[3].due_total, sums[3].est_seconds, sums[3].new_available) == (0, 0, 0)
    assert all(s.est_seconds <= s.budget for s in sums.values()) and {c.learner for c in cards} == {1, 2}
    cards, sums = run(spark, items, materials, [("active", None, None)], settings=Settings(daily_minutes=9, new_limit=2))
    assert sums[1].new_included == 2 and sums[1].deferred == 0


def test_what_is_no_candidate(spark):
    materials = [(0, 0, "qa", "active", False, 0), (1, 0, "qa", "rejected", False, 0), (2, 1, "qa", "active", False, 0), (3, 0, "qa", "active", True, 0), (4, 0, "cloze", "active", False, 0)]
    items = [known(1, 0, 0, buried=NOW + timedelta(hours=1)), known(1, 1, 1), new(1, 2, 2), new(1, 3, 3), new(1, 40, 4, "c10"), new(1, 41, 4, "c2"), known(1, 5, 0, suspended=True)]
    cards, sums = run(spark, items, materials, [("active", None, None), ("archived", None, None)])
    assert [(c.item_id, c.is_new) for c in cards] == [(41, True)] and sums[1].new_available == 1
    # once the rest of the topic was answered, its synthesis comes
    items = [i for i in items if i[1] not in (40, 41)] + [known(1, 40, 4, FAR)]
    assert [c.item_id for c in run(spark, items, materials, [("active", None, None), ("archived", None, None)])[0]] == [3]


def test_subjects_are_mixed_or_follow_each_other(spark):
    materials = [(m, m, "qa", "active", False, m) for m in range(20)]
    items, subjects = [new(1, m, m) for m in range(20)], [("active", None, datetime(2024, 5, 1).date()), ("active", None, datetime(2024, 4, 1).date())]
    mixed, _ = run(spark, items, materials, subjects, settings=Settings(new_per_day=20, daily_minutes=60))
    assert [c.subject_id for c in mixed[:4]] == [1, 0, 1, 0]
    blocks, _ = run(spark, items, materials, subjects, settings=Settings(new_per_day=20, daily_minutes=60, interleave=False))
    assert [c.subject_id for c in blocks] == [1] * 10 + [0] * 10 and [c.place for c in blocks] == list(range(20))


def test_limits_count_what_was_begun_today(spark):
    materials = [(m, m, "qa", "active", False, m) for m in range(12)]
    items = [new(1, m, m) for m in range(10)] + [known(1, 10, 10, FAR), known(1, 11, 11, FAR)]
    log = [(1, 10, NOW - timedelta(hours=2), 30_000, True), (2, 11, NOW - timedelta(days=3), 30_000, True), (3, 10, NOW, 500_000, False)]
    cards, sums = run(spark, items, materials, [("active", 3, None)], log, settings=Settings(new_per_day=8))
    assert sums[1].studied == 150 and sums[1].budget == 1050 and sums[1].new_included == 2
    cards, sums = run(spark, items, materials, [("active", None, None)], log, settings=Settings(new_per_day=8))
    assert sums[1].new_included == 7


def by_hand(items, budget, new_left):
    """First fit over due items, then new ones, as a plain loop for one subject without an exam."""
    used, out, deferred = 0, [], 0
    recall = lambda: (1 + (0.9 ** (1 / -0.1542) - 1) * 3 / 3.0) ** -0.1542
    due = [(-round((10 if i[4] in (1, 3) else 0) + (1 - recall()) * (0.5 + i[2] % 5 / 5), 9), i[1]) for i in items if i[4] and i[6] <= NOW]
    for _, item in sorted(due):
        if used + 12 <= budget:
            used, out = used + 12, [*out, item]
        else:
            deferred += 1
    if not deferred:
        for _, item in sorted((-(i[2] % 5 / 5), i[1]) for i in items if not i[4])[:new_left]:
            if used + 19 > budget:
                break
            used, out = used + 19, [*out, item]
    return sorted(out), used


@pytest.mark.parametrize("seed", range(2))
def test_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    materials = [(m, m, "qa", "active", False, 0) for m in range(60)]
    items = [rng.choice([known(u, u * 100 + m, m, state=rng.choice([1, 2, 3])), known(u, u * 100 + m, m, FAR), new(u, u * 100 + m, m)]) for u in range(8) for m in rng.sample(range(60), rng.randrange(1, 40))]
    cards, sums = run(spark, items, materials, [("active", None, None)], settings=Settings(daily_minutes=3, new_per_day=5))
    for u in range(8):
        want, used = by_hand([i for i in items if i[0] == u], 180, 5)
        assert sorted(c.item_id for c in cards if c.learner == u) == want and sums[u].est_seconds == used


def test_weeks_of_study_with_a_break(spark):
    """Every day's session is within its budget; after a break new items wait until the backlog is gone, and then come back."""
    rng, scheduler, n = random.Random(1), P.Scheduler(), 60
    materials = [(m, m % 7, "qa", "active", False, m) for m in range(n)]
    cards = {m: (0.0, 0.0) for m in range(n)}
    due, last, day = dict.fromkeys(cards), dict.fromkeys(cards), datetime(2024, 3, 1, 9)
    state = lambda m: 2 if last[m] else 0

    def study(day):
        rows = [(1, m, m, "c1", state(m), int(state(m) > 0), due[m], last[m], cards[m][0], False, None) for m in cards]
        chosen, sums = run(spark, rows, materials, [("active", None, datetime(2024, 6, 1).date())], settings=Settings(daily_minutes=3, new_per_day=20), now=day)
        assert sums[1].est_seconds <= sums[1].budget == 180
        for c in chosen:
            days = 0 if last[c.item_id] is None else (day - last[c.item_id]).days
            cards[c.item_id] = scheduler.step(cards[c.item_id], rng.choice([1, 3, 3, 4]), days)
            last[c.item_id], due[c.item_id] = day, day + timedelta(days=scheduler.interval(cards[c.item_id][0]))
        return sums[1]

    for _ in range(4):
        study(day)
        day += timedelta(days=1)
    day += timedelta(days=12)
    first = study(day)
    assert first.deferred > 0 and first.new_paused and first.new_included == 0 and first.backlog_days >= 1
    back = 0
    for _ in range(6):
        day += timedelta(days=1)
        back += study(day).new_included
        if back:
            break
    assert back > 0 and all(math.isfinite(s) and s > 0 for s, _ in cards.values() if s)
