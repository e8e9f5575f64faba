"""Random inputs against plain-Python statements of the rules."""

import math
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from affinity import schemas
from affinity.operators import engagement as E
from affinity.operators import purchase as P
from affinity.sources.scores import DEFAULT_EVENT_SCORES

SCORES = {e: s for e, _, s in DEFAULT_EVENT_SCORES}


def _ratings_by_rule(events):
    by = defaultdict(list)
    for site, user, item, code, ts in events:
        by[(site, user, item)].append((code, ts))
    out = {}
    for key, evs in by.items():
        pos = Counter(c for c, _ in evs if c > 0)
        neg = Counter(-c for c, _ in evs if c < 0)
        best = None
        for code, n in pos.items():
            net = max(n - neg.get(code, 0), 0)
            if net == 0:
                continue
            scores = SCORES[code]
            rating = scores[min(net, len(scores)) - 1]
            cand = (rating, -code)
            if best is None or cand > best:
                best = cand
        if best is not None:
            code = -best[1]
            latest = max(ts for c, ts in evs if c == code)
            out[key] = (float(best[0]), latest, code)
    return out


event_rows = st.lists(
    st.tuples(st.sampled_from(["s1", "s2"]), st.sampled_from(["u1", "u2", "u3"]), st.sampled_from(["a", "b"]),
              st.sampled_from([1, 2, 3, 4, 5, 6, 7, -1, -2, -3, -4, -5, -6, -7, 0]), st.integers(0, 50)),
    max_size=60)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=event_rows)
def test_engagement_matches_rule(spark, rows):
    df = spark.createDataFrame(rows, schemas.EVENT)
    got = {(r.site, r.user, r.item): (r.rating, r.timestamp, r.event) for r in E.engagement_ratings(df).collect()}
    assert got == _ratings_by_rule(rows)


line_rows = st.lists(
    st.tuples(st.sampled_from(["s1", "s2"]), st.sampled_from(["u1", "u2", "u3"]), st.sampled_from(["g1", "g2", "g3"]),
              st.integers(0, 5), st.integers(1, 4)),
    min_size=1, max_size=40)


def _prefs_by_rule(lines):
    orders = defaultdict(set)
    support = Counter()
    for site, user, group, _, item in lines:
        orders[(site, user)].add(group)
        support[(site, user, item)] += 1
    raw = {k: math.log(1 + v / len(orders[k[:2]])) for k, v in support.items()}
    top = defaultdict(float)
    for (site, user, item), p in raw.items():
        top[item] = max(top[item], p)
    return {k: math.floor(5 * (p / top[k[2]]) + 0.5) for k, p in raw.items()}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=line_rows)
def test_purchase_matches_rule(spark, rows):
    df = spark.createDataFrame(rows, schemas.ORDER_LINE)
    got = {(r.site, r.user, r.item): r.score for r in P.purchase_preferences(df).collect()}
    assert got == _prefs_by_rule(rows)
