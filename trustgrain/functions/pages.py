"""Page and request classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of block pages at any size, and wording that counts on short pages only.
STRONG_BLOCK_MARKERS = (
    "robot check",
    "temporarily blocked",
    "unusual traffic",
    "verify you are a human",
    "are you a human",
    "automated access to this page",
    "please enable javascript",
    "browser verification",
    "recaptcha",
)
WEAK_BLOCK_MARKERS = ("captcha", "access denied")
SHORT_PAGE = 10_000

# Parts of sign-in URLs.
SIGNIN_PARTS = ("/ap/signin", "/accounts/login", "/login?", "/login/phone", "/account/login")

# Requests that carry no review content.
RESOURCE_TYPES = ("image", "media", "font")
TRACKER_PARTS = (
    "google-analytics.com", "googletagmanager.com", "facebook.net", "facebook.com/tr", "doubleclick.net",
    "googlesyndication.com", "adservice.google.com", "analytics.", "hotjar.com", "clarity.ms", "sentry.io",
    "newrelic.com", "nr-data.net", "branch.io", "moengage.com", "clevertap.com", "webengage.com",
    "adobe-analytics", "omtrdc.net", "demdex.net",
)

# Card text that is page furniture instead of a review.
STARS = r"[\x{2605}\x{2606}\x{2B50}]"
FURNITURE = (
    r"(?i)Contact Us|About Us|Careers|Corporate Information|GROUP COMPANIES|Flipkart Stories|MAIL US|"
    r"REGISTERED OFFICE|Become a Seller|Help Centre|Gift Cards|CONSUMER COMPLAINTS|Payments|Shipping|Cancellation|"
    r"Returns|^\s*Ratings?\s*&\s*Reviews?\s*$"
)
BUYER_LINE = r"(?i)^\s*(Verified Purchase|Certified Buyer)"


def any_part(value: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(p)) for p in parts])


def is_blocked(html: Column) -> Column:
    """Block or captcha page.

    A page of more than 10,000 characters that mentions "recaptcha" passes, whatever else it says.
    """
    low, size = F.lower(html), F.length(html)
    excused = F.contains(low, F.lit("recaptcha")) & (size > SHORT_PAGE)
    strong = any_part(low, STRONG_BLOCK_MARKERS) & ~excused
    return strong | ((size < SHORT_PAGE) & any_part(low, WEAK_BLOCK_MARKERS))


def is_signin(url: Column) -> Column:
    return any_part(F.lower(url), SIGNIN_PARTS)


def is_tracker(url: Column, resource_type: Column) -> Column:
    return resource_type.isin(*RESOURCE_TYPES) | any_part(F.lower(url), TRACKER_PARTS)


def is_boilerplate(text: Column) -> Column:
    """Star bars, footers and buyer badges mistaken for a review. A rating histogram contains a star, so it is one."""
    return text.rlike(STARS) | text.rlike(FURNITURE) | text.rlike(BUYER_LINE)
