"""Options of searches, crawls and retention: validated once, on the driver, before any plan is built."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from urllib.parse import urlsplit

from corvina.operators.search import Filters

LANGUAGES, TYPES, SORTS = ("en", "ko", "ja", "zh", "other"), ("html", "pdf"), ("relevance", "newest")

_DOMAIN = re.compile(r"^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z0-9\-]{2,63}$")


class InvalidOption(ValueError):
    """An option that isn't allowed."""


def one_of(value: str | None, allowed: Sequence[str], name: str) -> str | None:
    if value is None or value == "":
        return None
    if value not in allowed:
        raise InvalidOption(f"{name} must be one of {', '.join(allowed)}")
    return value


def iso_day(value: str | None, name: str) -> str | None:
    """A day as YYYY-MM-DD that exists."""
    if value is None or value == "":
        return None
    try:
        if date.fromisoformat(value).isoformat() == value:
            return value
    except ValueError:
        pass
    raise InvalidOption(f"{name} must be a date like 2031-02-03")


def domain(value: str | None) -> str | None:
    if value is None or value.strip() == "":
        return None
    name = value.strip().lower()
    if not _DOMAIN.match(name):
        raise InvalidOption("domain must be a host name")
    return name


def search_filters(**options: str | None) -> Filters:
    """Filters from the raw options domain, since, until, language and document_type."""
    since, until = iso_day(options.get("since"), "since"), iso_day(options.get("until"), "until")
    if since and until and since > until:
        raise InvalidOption("since must not be after until")
    return Filters(domain(options.get("domain")), since, until, one_of(options.get("language"), LANGUAGES, "language"), one_of(options.get("document_type"), TYPES, "document_type"))


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """``value`` within bounds, ``default`` for None."""
    return default if value is None else max(low, min(high, int(value)))


@dataclass(frozen=True)
class CrawlLimits:
    max_pages: int = 100
    recrawl_minutes: int | None = None


def crawl_limits(max_pages: object = None, recrawl_minutes: object = None) -> CrawlLimits:
    """Pages 1 to 10,000 (100 if not given); recrawl every 15 to 43,200 minutes, 0 or nothing for never."""
    for name, value in (("max_pages", max_pages), ("recrawl_minutes", recrawl_minutes)):
        if value is not None and (isinstance(value, bool) or not isinstance(value, int)):
            raise InvalidOption(f"{name} must be a whole number")
    return CrawlLimits(clamp(max_pages, 1, 10_000, 100), clamp(recrawl_minutes, 15, 43_200, 15) if recrawl_minutes else None)


@dataclass(frozen=True)
class CrawlPolicy:
    max_depth: int | None = None
    request_interval_ms: int | None = None
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    allowed_content_types: tuple[str, ...] = ("text/html",)


def crawl_policy(raw: dict | None) -> CrawlPolicy:
    """A policy: at most 20 patterns of at most 120 characters a list, depth 0 to 20, 1,000 to 120,000 ms between requests."""
    raw = raw or {}

    def patterns(name: str) -> tuple[str, ...]:
        given = raw.get(name) or ()
        if not isinstance(given, (list, tuple)) or len(given) > 20 or any(not isinstance(p, str) or not p.strip() or len(p) > 120 for p in given):
            raise InvalidOption(f"{name} must be at most 20 patterns of at most 120 characters")
        return tuple(p.strip() for p in given)

    def number(name: str, low: int, high: int) -> int | None:
        value = raw.get(name)
        if value is None:
            return None
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise InvalidOption(f"{name} must be a whole number from {low} to {high}")
        return value

    types = tuple(t.strip().lower() for t in raw.get("allowed_content_types") or ("text/html",))
    return CrawlPolicy(number("max_depth", 0, 20), number("request_interval_ms", 1_000, 120_000), patterns("include_patterns"), patterns("exclude_patterns"), types)


@dataclass(frozen=True)
class Retention:
    cutoff: str
    delete_documents: bool = False
    dry_run: bool = True


def retention(cutoff: str, delete_documents: bool = False, dry_run: object = None) -> Retention:
    """A sweep; it is a dry run unless that is ruled out in so many words."""
    day = iso_day(cutoff, "cutoff")
    if day is None:
        raise InvalidOption("cutoff is required")
    return Retention(f"{day}T00:00:00.000Z", bool(delete_documents), dry_run is not False)


# Lifecycle events that can be sent, and those that are unless others are named.
EVENTS = ("crawl.submitted", "crawl.running", "crawl.completed", "crawl.failed", "crawl.cancelled", "crawl.paused", "crawl.resumed", "crawl.restarted", "crawl.retry_queued")
DEFAULT_EVENTS = ("crawl.completed", "crawl.failed", "crawl.cancelled")

#: Minutes between backups, backups that are kept (and by default), characters of a secret, an address and a user agent.
BACKUP_MINUTES, BACKUPS_KEPT, BACKUPS_DEFAULT = (15, 7 * 24 * 60), (1, 365), 7
SECRET_LENGTH, MOST_ADDRESS, MOST_AGENT = (16, 512), 2_000, 240


@dataclass(frozen=True)
class Operations:
    """How a service is run: where events go, how often tables are backed up, as whom pages are asked for."""

    webhook_url: str | None = None
    webhook_secret: str | None = None
    webhook_events: tuple[str, ...] = ()
    backup_minutes: int | None = None
    backups_kept: int = BACKUPS_DEFAULT
    user_agent: str = "corvina-bot/1.0"


def _whole(raw: str, low: int, high: int, name: str) -> int:
    if not re.fullmatch(r"[0-9]{1,9}", raw) or not low <= int(raw) <= high:
        raise InvalidOption(f"{name} must be a whole number from {low} to {high}")
    return int(raw)


def operations(settings: Mapping[str, str]) -> Operations:
    """Operations from settings as text: webhook_url, webhook_secret, webhook_events, backup_minutes, backups_kept, user_agent.

    Blank settings count as missing.  An address and a secret come together; the address is https without user and
    fragment.
    """
    given = {k: v.strip() for k, v in settings.items() if v is not None and v.strip()}
    out: dict = {}
    if "backup_minutes" in given:
        out["backup_minutes"] = _whole(given["backup_minutes"], *BACKUP_MINUTES, "backup_minutes")
        out["backups_kept"] = _whole(given.get("backups_kept", str(BACKUPS_DEFAULT)), *BACKUPS_KEPT, "backups_kept")
    if "user_agent" in given:
        if len(given["user_agent"]) > MOST_AGENT or not given["user_agent"].isprintable():
            raise InvalidOption(f"user_agent must be printable, of at most {MOST_AGENT} characters")
        out["user_agent"] = given["user_agent"]
    if ("webhook_url" in given) != ("webhook_secret" in given):
        raise InvalidOption("webhook_url and webhook_secret must be set together")
    if "webhook_url" in given:
        parts = urlsplit(given["webhook_url"])
        if parts.scheme != "https" or not parts.hostname or parts.username or parts.password or parts.fragment or len(given["webhook_url"]) > MOST_ADDRESS:
            raise InvalidOption("webhook_url must be an https address without user and fragment")
        if not SECRET_LENGTH[0] <= len(given["webhook_secret"]) <= SECRET_LENGTH[1]:
            raise InvalidOption(f"webhook_secret must have {SECRET_LENGTH[0]} to {SECRET_LENGTH[1]} characters")
        events = tuple(dict.fromkeys(e.strip() for e in given.get("webhook_events", ",".join(DEFAULT_EVENTS)).split(",") if e.strip()))
        if not events or any(e not in EVENTS for e in events):
            raise InvalidOption(f"webhook_events must be some of {', '.join(EVENTS)}")
        out |= {"webhook_url": given["webhook_url"], "webhook_secret": given["webhook_secret"], "webhook_events": events}
    return Operations(**out)


def admin_token(settings: Mapping[str, str]) -> str:
    """The token of the operator; there is no running without one."""
    token = (settings.get("admin_token") or "").strip()
    if not token:
        raise InvalidOption("admin_token must be set")
    return token


@dataclass(frozen=True)
class Session:
    """Open and recently closed pages of a reader."""

    tabs: tuple[tuple[str, str], ...] = ()
    active_url: str = ""
    recently_closed: tuple[tuple[str, str], ...] = ()


MOST_TABS = 20


def session_of(raw: Mapping | None) -> Session:
    """A session from stored JSON; entries without a title and an address as text are left out, ``MOST_TABS`` of a kind are kept."""
    raw = raw or {}

    def tabs(value: object) -> tuple[tuple[str, str], ...]:
        rows = value if isinstance(value, list) else []
        return tuple((t["title"], t["url"]) for t in rows if isinstance(t, Mapping) and isinstance(t.get("title"), str) and isinstance(t.get("url"), str))[:MOST_TABS]

    active = raw.get("active_url")
    return Session(tabs(raw.get("tabs")), active if isinstance(active, str) else "", tabs(raw.get("recently_closed")))
