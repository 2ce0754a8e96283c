"""Rule scoring of contacts (C5 to C12) and of organisations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactmill.functions.text import blank, check_amounts_compat, let


@dataclass(frozen=True)
class Profile:
    """What a score is relative to, its weights and modifiers. `as_of` is explicit: no query reads the clock."""

    as_of: str
    stage: str = "pre-seed"
    sectors: tuple[str, ...] = ("ai", "saas", "developer tools", "automation")
    check_min: int = 50_000
    check_max: int = 500_000
    stage_match: int = 30
    sector_match: int = 25
    check_size_fit: int = 20
    portfolio_relevance: int = 15
    recency: int = 10
    has_email: int = 10
    no_email: int = -15
    has_linkedin: int = 5
    stale: int = -10
    hot: int = 80
    warm: int = 60
    cool: int = 40

    def __post_init__(self) -> None:
        """Weights add up to 100 and tiers descend."""
        if abs(self.stage_match + self.sector_match + self.check_size_fit + self.portfolio_relevance + self.recency - 100) > 0.01:
            raise ValueError("the weights must add up to 100")
        if not self.hot > self.warm > self.cool > 0:
            raise ValueError("the tiers must descend")


# Fixed values.
STAGE_ORDER = ("pre-seed", "seed", "series-a", "series-b", "growth")
ROLES = (
    (15, ("partner", "gp", "managing director", "general partner", "founding partner", "venture partner")),
    (10, ("principal", "vice president", "vp", "director")),
    (5, ("associate", "analyst")),
    (-5, ("coordinator", "admin", "assistant", "intern", "receptionist", "office manager")),
)
STATUS_POINTS = {"verified": 8, "scraped": 5, "catch_all": 3, "guessed": 1, "unknown": 0, "undeliverable": -3}


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def stage_points(stage: Column, p: Profile) -> Column:
    w = p.stage_match
    mine = next((i for i, x in enumerate(STAGE_ORDER) if x in p.stage), None)

    def points(s: Column) -> Column:
        theirs = None
        for i, x in enumerate(STAGE_ORDER):
            theirs = (F if theirs is None else theirs).when(F.contains(s, F.lit(x)), i)
        steps = F.abs(theirs - mine) if mine is not None else F.lit(None).cast("int")
        near = let(steps, lambda d: F.when(d.isNull(), w // 3).when(d == 1, int(w * 0.6)).when(d == 2, int(w * 0.2)).otherwise(0))
        return F.when(s.isNull(), w // 3).when(F.contains(s, F.lit(p.stage)) | F.contains(F.lit(p.stage), s), w).otherwise(near)

    return let(F.lower(blank(stage)), points)


def _meets(sectors: Column, p: Profile) -> Column:
    """For each own sector the number of theirs that meet it: either contains the other."""
    mine = F.array(*map(F.lit, sorted(set(p.sectors)))) if p.sectors else F.expr("cast(array() as array<string>)")
    theirs = F.array_distinct(F.transform(F.coalesce(sectors, F.expr("cast(array() as array<string>)")), lambda t: F.lower(t)))
    return let(theirs, lambda ts: F.transform(mine, lambda m: F.size(F.filter(ts, lambda t: F.contains(t, m) | F.contains(m, t)))))


def sector_points(sectors: Column, p: Profile) -> Column:
    some, w = F.coalesce(F.size(sectors), F.lit(0)) > 0, p.sector_match
    if not p.sectors:
        return F.when(~some, w // 4).otherwise(w // 3)
    n = F.size(F.filter(_meets(sectors, p), lambda x: x > 0))
    return F.when(~some, w // 4).otherwise(F.floor(w * F.least(n / len(set(p.sectors)) * 1.5, F.lit(1.0)))).cast("int")


def portfolio_points(sectors: Column, p: Profile) -> Column:
    w, some = p.portfolio_relevance, F.coalesce(F.size(sectors), F.lit(0)) > 0
    n = F.aggregate(_meets(sectors, p), F.lit(0), lambda a, x: a + x)
    return F.when(~some | F.lit(not p.sectors), w // 4).otherwise(let(n, lambda k: F.when(k >= 2, w).when(k == 1, int(w * 0.6)).otherwise(int(w * 0.1))))


def check_points(check: Column, p: Profile) -> Column:
    w = p.check_size_fit

    def points(amounts: Column) -> Column:
        overlap = (F.array_min(amounts) <= p.check_max) & (F.array_max(amounts) >= p.check_min)
        return F.when(F.coalesce(F.size(amounts), F.lit(0)) == 0, w // 3).when(overlap, w).otherwise(int(w * 0.15))

    return let(check_amounts_compat(blank(check)), points)


def age_days(at: Column, p: Profile) -> Column:
    return (F.unix_micros(F.lit(p.as_of).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400e6


def recency_points(at: Column, p: Profile) -> Column:
    w = p.recency
    return let(F.greatest(age_days(at, p), F.lit(0.0)), lambda d: F.when(at.isNull(), w // 2).when(d < 1, w).otherwise(F.greatest(F.lit(1), F.floor(w * F.exp(-0.693 * d / 14)).cast("int"))))


def role_points(role: Column) -> Column:
    def points(r: Column) -> Column:
        out = None
        for n, keys in ROLES:
            out = (F if out is None else out).when(_any(r, keys), n)
        return out.otherwise(0)

    return let(F.lower(blank(role)), points)


def engagement_points(email: Column, status: Column, linkedin: Column, seen: Column) -> Column:
    points = None
    for label, n in STATUS_POINTS.items():
        points = (F if points is None else points).when(status == label, n)
    full = has_email(email) & has_linkedin(linkedin)
    return points.otherwise(0) + F.when(seen >= 3, 3).when(seen >= 2, 1).otherwise(0) + F.when(full, 2).otherwise(0)


def has_email(email: Column) -> Column:
    return F.coalesce(F.contains(blank(email), F.lit("@")), F.lit(False))


def has_linkedin(url: Column) -> Column:
    return F.coalesce(F.contains(blank(url), F.lit("linkedin")), F.lit(False))


def total(p: Profile, stage: Column, sectors: Column, check: Column, at: Column, role: Column, email: Column, status: Column, linkedin: Column, seen: Column) -> Column:
    """The clamped sum of all parts."""
    parts = stage_points(stage, p) + sector_points(sectors, p) + check_points(check, p) + portfolio_points(sectors, p) + recency_points(at, p) + role_points(role) + engagement_points(email, status, linkedin, seen)
    extra = F.when(has_email(email), p.has_email).otherwise(p.no_email) + F.when(has_linkedin(linkedin), p.has_linkedin).otherwise(0) + F.when(F.floor(age_days(at, p)) > 60, p.stale).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), parts + extra)).cast("int")


def tier(score: Column, p: Profile) -> Column:
    return F.when(score >= p.hot, "HOT").when(score >= p.warm, "WARM").when(score >= p.cool, "COOL").otherwise("COLD")


TIER_LABELS = {"HOT": "🔴 HOT", "WARM": "🟡 WARM", "COOL": "🟢 COOL", "COLD": "⚪ COLD"}


def tier_label(t: Column) -> Column:
    """The presentation of a tier, for sinks."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIER_LABELS.items() for x in kv]), t)


def tier_of_label(label: Column) -> Column:
    """The tier in any label; what is unknown becomes COOL."""
    up = F.upper(F.regexp_extract(label, r"([A-Za-z]+)\s*$", 1))
    return F.when(up.isin("HOT", "WARM", "COOL"), up).otherwise("COOL")


def active_status(recent_company: Column, older_company: Column, recent_post: Column, recent_news: Column, companies: Column) -> Column:
    """C17: evidence summed: companies this year or last .4, before .2, posts .2, news .3, five companies .1."""
    e = F.when(recent_company, 0.4).when(older_company, 0.2).otherwise(0.0) + F.when(recent_post, 0.2).otherwise(0.0) + F.when(recent_news, 0.3).otherwise(0.0) + F.when(companies >= 5, 0.1).otherwise(0.0)
    e = F.round(e, 6)
    return F.struct(e.alias("evidence"), F.when(e >= 0.5, "active").when(e >= 0.2, "possibly_active").when(e > 0, "stale").otherwise("unknown").alias("status"))


def lead_or_follow(lead_phrases: Column, follow_phrases: Column, lead_news: Column, follow_news: Column) -> Column:
    """.3 a phrase on the home page, .1 a news item; the greater side wins."""
    a, b = F.round(0.3 * lead_phrases + 0.1 * lead_news, 6), F.round(0.3 * follow_phrases + 0.1 * follow_news, 6)
    return F.when((a == 0) & (b == 0), "unknown").when(a > b, "lead").when(b > a, "follow").otherwise("both")


def page_type_score(path: Column, keywords: tuple[str, ...]) -> Column:
    """C20: .9 for a segment, .7 for a part of the path, a fifth less below two levels; null if nothing fits."""
    segments = F.split(path, "/")
    exact = F.arrays_overlap(segments, F.array(*map(F.lit, keywords)))
    base = F.when(path == "", None).when(exact, 0.9).when(_any(path, keywords), 0.7)
    return F.round(base * F.when(F.size(segments) > 2, 0.8).otherwise(1.0), 4)


def outcome_score(flags: list[tuple[Column, int]]) -> Column:
    """Weighted flags, 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), sum((F.when(f, w).otherwise(0) for f, w in flags), F.lit(0))))
