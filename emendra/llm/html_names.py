"""What tags and names of elements say about their part of a page."""

from __future__ import annotations

import re

#: Elements that never belong to the main text.
NEVER = frozenset("nav footer aside form script style noscript iframe button select option textarea input dialog menu template head title object canvas svg audio video noembed noframes xmp".split())
#: Elements and names that are boilerplate around the main part, but may be its own inside.
AROUND = frozenset("header masthead social tags search foot skip toolbar contentinfo complementary".split())
#: Any of these in a name marks boilerplate.
HARD = re.compile(
    r"ads?|advert\w*|adsense|adslot|banners?|sponsor\w*|promo\w*|promotions?|cookies?|gdpr|popup|modal|overlay|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|widgets?|"
    r"comments|commentlist|disqus|footer|share|sharing|sharebar|newsletter|signup|login|pagination|pager|searchbox|searchform"
)
#: These mark boilerplate if nothing else in the name says what the part is about.
SOFT = re.compile(r"notices?|alerts?|warning|consent|comment|replies|reply|respond|related|recommend\w*|subscribe|subscription|hidden|invisible")
GENERIC = frozenset(
    "box block area wrapper wrap container content section list links link item items post posts article articles story stories bar inner outer top bottom left right main unit slot module panel "
    "group form btn button buttons icons holder region site page global the my js id system view row col message text body block".split()
)
MAIN_TAGS = ("article", "main")
MAIN = re.compile(r"(?:^|[\s_-])(?:main|article(?:-?body)?|post(?:-?(?:body|content))?|entry(?:-?content)?|content|story(?:-?body)?)(?:$|[\s_-])")
#: Marks of inline elements, which are part of a sentence more often than not.
INLINE = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|notices?|popup|hidden|invisible")

_parts = re.compile(r"[^a-z]+").split


def _strong(name: str) -> bool:
    parts = [p for p in _parts(name) if p]
    if any(map(HARD.fullmatch, parts)):
        return True
    soft = [p for p in parts if SOFT.fullmatch(p)]
    return bool(soft) and all(p in GENERIC for p in parts if p not in soft)


_SEEN: dict[tuple[str, str], str] = {}


def mark(tag: str, names: str) -> str:
    """"!" for boilerplate, "?" for boilerplate around the main part, "*" for a main part, or nothing."""
    known = _SEEN.get((tag, names))
    if known is None:
        own = names.split()
        if tag in NEVER or any(map(_strong, own)):
            known = "!"
        elif tag in AROUND or any(p in AROUND for n in own for p in _parts(n)):
            known = "?"
        else:
            known = "*" if names and MAIN.search(names) else ""
        if len(_SEEN) > 20_000:
            _SEEN.clear()
        _SEEN[tag, names] = known
    return known


def inline_boilerplate(names: str) -> bool:
    """Whether an inline element's names mark an advert, a notice or something hidden."""
    return any(parts and any(map(INLINE.fullmatch, parts)) and all(p in GENERIC or INLINE.fullmatch(p) for p in parts) for parts in ([p for p in _parts(n) if p] for n in names.split()))
