import random
from datetime import timedelta
from statistics import median

import pytest
from conftest import SPAN, T0, utc

from footfall import operators as op
from footfall.operators import funnels
from footfall.plans import skew

MINUTE, HOUR, DAY = timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)
PV, SU, PU = "page_view", "signup", "purchase"


@pytest.fixture(params=["small", "large"])
def size(request, monkeypatch):
    """Both ways to run a funnel must give the same answer."""
    if request.param == "large":
        monkeypatch.setattr(funnels, "SMALL_ROWS", -1)
        monkeypatch.setattr(skew, "HEAVY_ROWS", 1)


def run(events, *steps, window="7d", **more):
    return op.funnel(events, 1, list(steps), window, **{**SPAN, **more}).collect()


def actors(rows):
    return [row.actors for row in rows]


def test_in_order(size, make):
    make.add(PV, actor="a").add(SU, HOUR, "a").add(PU, 2 * HOUR, "a")
    make.add(PV, actor="b").add(SU, HOUR, "b").add(PV, actor="c")
    rows = run(make.table(), PV, SU, PU)
    assert [(r.step, r.event_type) for r in rows] == [(1, PV), (2, SU), (3, PU)]
    assert actors(rows) == [3, 2, 1]
    assert [r.conversion_from_previous for r in rows] == [1.0, 2 / 3, 0.5]
    assert [r.conversion_from_first for r in rows] == [1.0, 2 / 3, 1 / 3]
    reported = op.funnel(make.table(), 1, [PV, SU, PU], "24h", **SPAN)
    assert tuple(op.funnel_totals(reported, [PV, SU, PU], "24h").first()) == ("1d", 3, 1, 1 / 3)


def test_out_of_order_and_repeats(size, make):
    make.add(PU, actor="a").add(PV, HOUR, "a").add(SU, 2 * HOUR, "a")
    assert actors(run(make.table(), PV, SU, PU)) == [1, 1, 0]
    for minutes in (0, 5, 10):
        make.add("open", minutes * MINUTE, "r")
    make.add("done", 20 * MINUTE, "r")
    rows = run(make.table(), "open", "done")
    assert actors(rows) == [1, 1] and rows[1].median_seconds_from_previous == 1200.0


def test_window_counts_from_entry_inclusive(size, make):
    make.add(PV, actor="slow").add(SU, 10 * DAY, "slow").add(PV, actor="fast").add(SU, DAY, "fast")
    assert actors(run(make.table(), PV, SU)) == [2, 1]
    assert actors(run(make.table(), PV, SU, window="30d")) == [2, 2]
    make.add("x", actor="a").add("y", 2 * DAY, "a").add("z", 4 * DAY, "a")
    assert actors(run(make.table(), "x", "y", "z", window="3d")) == [1, 1, 0]
    assert actors(run(make.table(), "x", "y", "z", window="4d")) == [1, 1, 1]
    assert actors(run(make.table(), "x", "y", "z", window="5759m")) == [1, 1, 0]


def test_first_entry_stays_the_anchor(size, make):
    make.add(PV, actor="a").add(PV, 9 * DAY, "a").add(SU, 10 * DAY, "a")
    assert actors(run(make.table(), PV, SU)) == [1, 0]


def test_equal_times_do_not_advance(size, make):
    make.add(PV, actor="a").add(SU, actor="a")
    assert actors(run(make.table(), PV, SU)) == [1, 0]
    make.add(SU, timedelta(microseconds=1), "a")
    assert actors(run(make.table(), PV, SU)) == [1, 1]


def test_same_type_twice(size, make):
    make.add(PV, actor="a").add(PV, actor="a").add(PV, actor="b").add(PV, HOUR, "b")
    assert actors(run(make.table(), PV, PV)) == [2, 1]


def test_stitching(size, make):
    make.add(PV, actor="anon-1").add(SU, HOUR, "anon-1", "user-9").add(PU, 2 * HOUR, "anon-1", "user-9")
    make.add(PV, actor="anon-2").add("other", DAY, "anon-2", "user-8").add(SU, HOUR, user="user-8")
    assert actors(run(make.table(), PV, SU, PU)) == [2, 2, 1]
    # Linked outside the range: two people.
    early = {"end": T0 + 90 * MINUTE}
    assert actors(run(make.table(), PV, SU, PU, **early)) == [2, 1, 0]


def test_filter_narrows_steps_and_not_identity(size, make):
    make.add(PV, actor="a", metadata='{"plan":"pro"}').add("link", MINUTE, "a", "u")
    make.add(SU, HOUR, user="u", metadata='{"plan":"pro"}').add(PV, actor="b")
    assert actors(run(make.table(), PV, SU, filters=["plan:pro"])) == [1, 1]


def test_medians(size, make):
    make.add(PV, actor="a").add(SU, 10 * MINUTE, "a").add(PV, actor="b").add(SU, 30 * MINUTE, "b")
    rows = run(make.table(), PV, SU)
    assert [r.median_seconds_from_previous for r in rows] == [None, 1200.0]
    make.add(PV, actor="c").add(SU, timedelta(microseconds=7), "c")
    assert run(make.table(), PV, SU)[1].median_seconds_from_previous == 600.0


def test_nobody(size, make):
    make.add(PV).add(SU, HOUR).add(PV, actor="a", org=2).add(SU, HOUR, "a", org=2)
    rows = run(make.table(), PV, SU)
    assert [tuple(r)[2:] for r in rows] == [(0, 1.0, 0.0, None), (0, 0.0, 0.0, None)]


def test_conversion_after_the_range_is_not_seen(size, make):
    make.add(PV, at=utc(2026, 5, 31, 23), actor="a").add(SU, at=utc(2026, 6, 1, 1), actor="a")
    assert actors(run(make.table(), PV, SU)) == [1, 0]


def walk(times, steps, window):
    """The definition, for one person: the earliest fitting event, step by step."""
    reached = []
    for step in steps:
        fits = [
            at for kind, at in times if kind == step
            and (not reached or reached[-1] < at <= reached[0] + window)
        ]
        if not fits:
            break
        reached.append(min(fits))
    return reached


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force_with_a_busy_person(size, make, seed):
    rng = random.Random(seed)
    steps, window = rng.choices("xyz", k=rng.randint(2, 6)), timedelta(days=rng.randint(1, 9))
    people = {}
    for _ in range(900):
        # A third of all events are one person's, under several anonymous ids.
        person = "busy" if rng.random() < 1 / 3 else f"p{rng.randrange(60)}"
        at = T0 + timedelta(minutes=rng.randrange(20_000))
        kind = rng.choice("xyzw")
        people.setdefault(person, []).append((kind, at))
        device = f"{person}-{rng.randrange(5)}"
        shape = rng.choice(["anonymous", "user", "both"])
        make.add(kind, at=at, actor=None if shape == "user" else device,
                 user=None if shape == "anonymous" else person)
    # Links every device to its person whatever the draw.
    for person in people:
        for n in range(5):
            make.add("link", at=SPAN["start"], actor=f"{person}-{n}", user=person)
    walks = [walk(times, steps, window) for times in people.values()]
    expected = [sum(len(w) > n for w in walks) for n in range(len(steps))]
    rows = run(make.table(), *steps, window=f"{window.days}d")
    assert actors(rows) == expected
    for n in range(1, len(steps)):
        took = [(w[n] - w[n - 1]).total_seconds() for w in walks if len(w) > n]
        assert rows[n].median_seconds_from_previous == (pytest.approx(median(took)) if took else None)


def test_only_crowded_persons_are_thinned_out(make, monkeypatch):
    """Many events in all are no reason to thin out those of people who have few."""
    thinned, seen = funnels.thinned, set()

    def spy(rows, *more):
        seen.update(row.actor for row in rows.select("actor").distinct().collect())
        return thinned(rows, *more)

    monkeypatch.setattr(funnels, "thinned", spy)
    for n in range(30):
        make.add([PV, SU][n % 2], n * MINUTE, "busy").add([SU, PV][n % 2], n * MINUTE, f"p{n % 5}")
    events = make.add(PU, HOUR, "busy").add(PU, HOUR, "p1").table()
    whole = run(events, PV, SU, PU, PV)
    assert not seen and actors(whole)[0] == 6
    assert run(events, PV, SU, PU, PV, small_rows=20) == whole and seen == {"busy"}
    seen.clear()
    assert run(events, PV, SU, PU, PV, small_rows=40) == whole and not seen
    assert run(events, PV, SU, PU, PV, small_rows=0) == whole and len(seen) == 6
