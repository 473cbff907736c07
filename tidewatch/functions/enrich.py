"""Ingest enrichment as native Column expressions: nothing here leaves whole-stage codegen for Python."""

from __future__ import annotations

import hashlib
import hmac
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schema import PAGEVIEW

# Fixed values, whose order is the order of the rules.
PAGEVIEW_NAMES = ("pageview", "page_view", "page-view", "pageView", "PageView")
CLICK_IDS = ("gclid", "gbraid", "wbraid", "fbclid", "msclkid", "ttclid", "li_fat_id")
MEDIA = {
    "paid": ("cpc", "ppc", "paid", "paidsearch", "paid_search", "cpm", "cpv", "display", "banner"),
    "email": ("email", "e-mail", "newsletter"),
    "social": ("social", "social-network", "social_media", "paid-social"),
    "affiliate": ("affiliate",),
    "referral": ("referral",),
    "organic": ("organic",),
}
SEARCH_HOSTS = ("google.", "bing.com", "duckduckgo.com", "yahoo.", "yandex.", "baidu.com", "ecosia.org", "brave.com", "search.marginalia.nu", "startpage.com", "qwant.com", "naver.com", "ask.com")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "twitter.com", "x.com", "t.co", "linkedin.com", "lnkd.in", "reddit.com", "pinterest.", "tiktok.com", "youtube.com", "youtu.be", "whatsapp.com", "telegram.", "t.me", "threads.net", "mastodon.", "bsky.app", "news.ycombinator.com", "quora.com")
ASSISTANTS = {  # name: (referrer hosts, utm_source values)
    "ChatGPT": (("chatgpt.com", "chat.openai.com", "com.openai.chatgpt"), ("chatgpt.com", "chatgpt", "openai", "chat.openai.com")),
    "Perplexity": (("perplexity.ai", "ai.perplexity.app"), ("perplexity", "perplexity.ai")),
    "Copilot": (("copilot.microsoft.com", "copilot.cloud.microsoft", "edgeservices.bing.com", "com.microsoft.copilot"), ("copilot", "copilot.microsoft.com", "bing_chat")),
    "Gemini": (("gemini.google.com", "bard.google.com", "com.google.android.apps.bard"), ("gemini", "gemini.google.com", "bard")),
    "Claude": (("claude.ai", "com.anthropic.claude"), ("claude", "claude.ai")),
    "Mistral": (("chat.mistral.ai",), ("mistral", "chat.mistral.ai")),
    "DeepSeek": (("chat.deepseek.com",), ("deepseek", "chat.deepseek.com")),
    "Meta AI": (("meta.ai",), ("meta.ai", "metaai")),
    "Grok": (("grok.com",), ("grok", "grok.com")),
    "You.com": (("you.com",), ("you.com",)),
    "Phind": (("phind.com",), ("phind", "phind.com")),
    "Poe": (("poe.com",), ("poe", "poe.com")),
    "Duck.ai": (("duck.ai",), ("duck.ai",)),
}
BROWSERS = (("Edge", ("edg/", "edga/", "edgios/")), ("Opera", ("opr/", "opera")), ("Samsung Internet", ("samsungbrowser",)), ("Chrome", ("crios/",)), ("Firefox", ("fxios/", "firefox/")), ("Chrome", ("chrome/", "chromium/")), ("Safari", ("safari/",)), ("Internet Explorer", ("msie ", "trident/")))
SYSTEMS = (("Android", ("android",)), ("iOS", ("iphone", "ipad", "ipod")), ("Windows", ("windows nt",)), ("ChromeOS", ("cros",)), ("macOS", ("mac os x", "macintosh")), ("Linux", ("linux",)))
BOTS = ("bot", "crawler", "spider", "crawling", "slurp", "curl/", "wget/", "python-requests", "go-http-client", "headlesschrome", "phantomjs", "lighthouse", "pingdom", "uptimerobot", "facebookexternalhit", "preview", "monitoring", "scrapy")
CLAMPS = {"click_x": 10_000, "click_y": 200_000, "viewport": 20_000, "interactive": 1, "scroll_pct": 100, "viewport_h": 20_000, "doc_h": 2_000_000}


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _one_of(values) -> str:
    """A pattern for any of the values."""
    return "(" + "|".join(re.escape(v) for v in values) + ")"


def _no_www(host: Column) -> Column:
    return F.regexp_replace(host, "^www\\.", "")


def canonical_event(name: Column) -> Column:
    return F.when(name.isin(*PAGEVIEW_NAMES), PAGEVIEW).otherwise(name)


# URLs are taken apart by pattern, in one pass; what is no URL (control characters, a broken escape in the path, a port
# that is no number, a host with characters that none has) has neither host nor path.
_URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?\/\/([^\/?#]*)([^?#]*)(\?[^#]*)?"
# Bytes that stand in a host, that a path may have as they are, and that escaping a path leaves.
_HOST = r"""^(?:[^@]*@)?(?:\[[0-9a-fA-F:.]*\]|[a-zA-Z0-9\-_.~!$&'()*+,;="<>%\x{80}-\x{10ffff}]*)(?::[0-9]*)?$"""
_PATH = r"^[a-zA-Z0-9\-_.~$&+,/:;=@!'()*\[\]%]*$"
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~$&+,/:;=@"


def _is_url(url: Column) -> Column:
    url = _empty(url)
    broken = url.rlike(r"[\x00-\x1f\x7f]") | F.regexp_extract(url, _URL, 2).rlike("%(?![0-9a-fA-F]{2})")
    return ~broken & F.regexp_extract(url, _URL, 1).rlike(_HOST)


def _escaped(path: Column) -> Column:
    """Decoded, and each byte that isn't plain written as an escape."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    pairs = F.split(F.hex(F.encode(decoded, "UTF-8")), r"(?<=\G..)")
    plain = F.create_map(*(F.lit(x) for c in _PLAIN for x in (f"{ord(c):02X}", c)))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p != ""), lambda p: F.coalesce(F.try_element_at(plain, p), F.concat(F.lit("%"), p))), "")


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and brackets; '' where there is none."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(_empty(url), _URL, 1), "^.*@", ""), r":[0-9]*$", "")
    return F.when(_is_url(url), F.lower(F.regexp_replace(host, r"^\[(.*)\]$", "$1"))).otherwise("")


def url_path(url: Column) -> Column:
    """Escaped path without query and fragment; '/' for none; no slash at the end but the root's."""
    raw = F.regexp_extract(_empty(url), _URL, 2)
    path = F.regexp_replace(F.when(raw.rlike(_PATH), raw).otherwise(_escaped(raw)), "/+$", "")
    return F.when(url_host(url) == "", "").otherwise(F.when(path == "", "/").otherwise(path))


def url_parameter(url: Column, name: str) -> Column:
    """The decoded value of a query parameter; '' where it is absent or can't be decoded."""
    raw = F.regexp_extract(F.regexp_extract(_empty(url), _URL, 3), f"[?&]{name}=([^&;]*)(?:&|$)", 1)
    return F.when(raw == "", "").otherwise(_empty(F.try_url_decode(raw)))


def has_click_id(url: Column) -> Column:
    return F.regexp_extract(_empty(url), _URL, 3).rlike(f"[?&]{_one_of(CLICK_IDS)}=(?:[^&%;]|%[0-9a-fA-F]{{2}})+(?:&|$)")


def referrer_host(referrer: Column) -> Column:
    return url_host(referrer)


def assistant(host: Column, utm_source: Column) -> Column:
    """The AI assistant that a visit came from: by its referrer, else by what its link says; '' for none."""
    # One pattern and one look-up each; no two assistants share a value, so their order doesn't matter.
    by_host = {d: name for name, (hosts, _) in ASSISTANTS.items() for d in hosts}
    by_link = {v: name for name, (_, links) in ASSISTANTS.items() for v in links}
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    domain = F.regexp_extract(F.lower(_empty(host)), rf"(?:^|\.){_one_of(by_host)}$", 1)
    link = _no_www(F.lower(F.trim(_empty(utm_source))))
    return F.coalesce(F.try_element_at(table(by_host), domain), F.try_element_at(table(by_link), link), F.lit(""))


def channel(host: Column, page_host: Column, utm_source: Column, utm_medium: Column, click_id: Column) -> Column:
    host, medium = _empty(host), F.lower(_empty(utm_medium))
    h = _no_www(host)
    rules = F.when((host != "") & (h == _no_www(_empty(page_host))), "internal")
    rules = rules.when(~medium.isin(*MEDIA["paid"]) & ~click_id & (assistant(host, utm_source) != ""), "ai")
    for name, values in MEDIA.items():
        rules = rules.when(medium.isin(*values), name)
    rules = rules.when(click_id, "paid").when(host == "", "direct")
    rules = rules.when(h.rlike(f"^{_one_of(SEARCH_HOSTS)}") | h.isin(*(s.rstrip(".") for s in SEARCH_HOSTS)), "organic")
    return rules.when(h.rlike(f"^{_one_of(SOCIAL_HOSTS)}"), "social").otherwise("referral")


def user_agent(ua: Column) -> Column:
    """struct(browser, os, device, platform, bot); all empty for an empty agent."""
    low = F.lower(_empty(ua))
    has = lambda *tokens: low.rlike(_one_of(tokens))

    def first(rules) -> Column:
        out = F.lit("")
        for name, tokens in reversed(rules):
            out = F.when(has(*tokens), name).otherwise(out)
        return out

    device = F.when(has("ipad", "tablet"), "tablet").when(has("android") & ~has("mobile"), "tablet").when(has("mobile", "iphone", "ipod"), "mobile").otherwise("desktop")
    platform = F.when(has("; wv)", " wv "), "mobile_app").when(has("iphone", "ipad") & has("applewebkit") & ~has("safari/"), "mobile_app").otherwise("web")
    some = low != ""
    known = lambda c: F.when(some, c).otherwise("")
    return F.struct(known(first(BROWSERS)).alias("browser"), known(first(SYSTEMS)).alias("os"), known(device).alias("device"), known(platform).alias("platform"), (some & has(*BOTS)).alias("bot"))


def daily_salt(secret: bytes, day: str) -> bytes:
    """The salt of one UTC day; drawn on the driver."""
    return hmac.new(secret, day.encode(), hashlib.sha256).digest()


def visitor_id(ip: Column, ua: Column, site: Column, salt: Column) -> Column:
    """URL-safe base64 of 16 bytes of sha256 over the salt and the length-prefixed parts; ``salt`` is binary."""
    parts = [salt]
    for c in (ip, ua, site):
        data = _empty(c).cast("binary")
        size = F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")
        little = F.concat(*(F.substring(size, i, 2) for i in range(15, 0, -2)))
        parts += [F.unhex(little), data]
    digest = F.unhex(F.sha2(F.concat(*parts), 256))
    return F.translate(F.base64(F.substring(digest, 1, 16)), "+/=", "-_")


def client_ip(edge: Column, forwarded: Column, socket: Column) -> Column:
    first = F.trim(F.element_at(F.split(_empty(forwarded), ","), 1))
    return F.when(_empty(edge) != "", edge).when(_empty(forwarded) != "", first).otherwise(F.regexp_replace(F.regexp_replace(_empty(socket), r":\d+$", ""), r"^\[(.*)\]$", "$1"))


def country(code: Column) -> Column:
    return F.when(_empty(code).isin("XX", "T1"), "").otherwise(_empty(code))


def clamp(value: Column, name: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.coalesce(value, F.lit(0)).cast("long"), F.lit(CLAMPS[name]))).cast("int")


def event_path(own: Column, batch: Column) -> Column:
    """Path of one event: of its own absolute URL; a relative one as it is; else the batch's."""
    own = _empty(own)
    return F.when(url_host(own) != "", url_path(own)).when(own.startswith("/"), own).otherwise(url_path(batch))


def crawl_path(path: Column) -> Column:
    """Path of a crawl hit; null where it isn't one. At most 512 bytes of ASCII."""
    cut = F.regexp_extract(_empty(path), r"^[^?#]*", 0)
    trimmed = F.regexp_replace(cut, "/+$", "")
    return F.when(cut.startswith("/"), F.substring(F.when(trimmed == "", "/").otherwise(trimmed), 1, 512))


def crawl_valid(site: Column, bot: Column, path: Column) -> Column:
    s, b = F.trim(_empty(site)), F.trim(_empty(bot))
    return s.rlike(r"^[A-Za-z0-9_.-]{1,128}$") & ~s.endswith(".crawl") & b.rlike(r"^[\x20-\x7e]{1,64}$") & crawl_path(path).isNotNull()


def crawl_props(status: Column) -> Column:
    return F.concat(F.lit('{"status":'), F.when(status.between(100, 599), status).otherwise(0).cast("string"), F.lit("}"))


def site_of(url: Column, origin: Column, referer: Column) -> Column:
    """First host of the three, without www.; '' for none."""
    hosts = [url_host(c) for c in (url, origin, referer)]
    return _no_www(F.coalesce(*(F.when(h != "", h) for h in hosts), F.lit("")))


def site_key(client: Column, app: Column) -> Column:
    return F.concat(F.lower(app), F.lit("_"), F.upper(client))


def tenant_site(ua: Column, url: Column, origin: Column, host_site: Column, app_tag: str, path_hosts: tuple[str, ...] = ()) -> Column:
    """Site of a request: by the tag that an app's wrapper adds to its agent, by a path-prefixed URL on an allowed host whose Origin agrees, else ``host_site`` (looked up by the request's host)."""
    tag = rf"{app_tag}\S*\s+([^/\s]+)/(\S+)"
    client, app = F.regexp_extract(_empty(ua), tag, 1), F.regexp_extract(_empty(ua), tag, 2)
    path = F.regexp_extract(_empty(url), _URL, 2)
    head = F.when(path.contains("/page/"), F.regexp_extract(path, "^(.*?)/page/", 1)).otherwise(F.regexp_extract(path, "^(.*?)/manifest/", 1))
    of = lambda i: F.regexp_extract(head, "^/([^/]+)/([^/]+)", i)
    host = url_host(url)
    by_path = (of(2) != "") & (host != "") & (host == url_host(origin)) & (host.isin(*path_hosts) if path_hosts else F.lit(False))
    return F.when((client != "") & (app != ""), site_key(client, app)).when(by_path, site_key(of(2), of(1))).otherwise(_empty(host_site))


def request_host(url: Column, origin: Column, referer: Column) -> Column:
    """The host to look a site up by: the page's while its Origin agrees, else the Origin's; the Referer's last."""
    page, own = url_host(url), url_host(origin)
    return F.when((page != "") & (own != "") & (page != own), own).when(page != "", page).when(own != "", own).otherwise(url_host(referer))
