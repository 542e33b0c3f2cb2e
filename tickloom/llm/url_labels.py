"""A small labelled URL table for the filter, built by rule from two word lists.

Every word of a list stands alone in a host and is paired with others of its list; prefixes, endings and paths are dealt
out alike over both lists, so that they carry no weight. Pass another table to `url_filter.fit` for another policy.
"""

#: Words of hosts that are unwanted: gambling, drugs, adult content, advertising, link spam, loans, fraud, malware.
UNWANTED = """
casino slots jackpot win winner prizes bets betting bet poker bingo roulette lottery freespins bonus free gift
cheap discount pills pharmacy viagra cialis meds prescription drugs diet replica
adult xxx porn sex cams escort nude dating singles hot x
ads ad track tracker click popup banner adserver pixel
spam spambot farm links backlinks seo followers likes
loans payday cash rich bitcoin crypto forex profit
warez crack keygen torrent phish malware virus hacked
""".split()

#: Words of hosts that are wanted.
WANTED = """
news post herald times weather report science press library health museum gallery garden cooking recipes
source docs reference manual language school university education students teachers travel mountain river
bird astronomy mathematics physics chemistry biology medical journal hospital council parliament archive law
railway harbour bridge engineering theatre orchestra film festival book reviews poetry encyclopedia dictionary
statistics economics forestry ocean climate geology maps station street south north heath thistle thread
translation nation nations tables ethos stone listening weathering software python robotics chess football cycling wiki
bakery children stories forum volunteers office letters notes hearth home other thing things thought ending
""".split()

#: Parts of made-up names: most hosts are named with words that no list knows, and are wanted.
PARTS = "ba ren to li mar sken do vi tal or fin gus wel ham ny per ka lo us mon the ri ent sta el".split()

_STARTS, _ENDS = ("", "www.", "m.", "blog.", "shop."), ("com", "net", "org", "example.com", "example.net", "example.org")
_PATHS = ("/", "/en/12", "/de/7.html", "/fr/890/", "/es/41", "/en/5521.html", "/index.html", "")


def _hosts(words: list[str]) -> list[str]:
    """Each word alone, with the next one and with the one a third of the list away."""
    n = len(words)
    return [*words, *(f"{w}-{words[(i + 1) % n]}" for i, w in enumerate(words)), *(f"{words[(i + n // 3) % n]}-{w}" for i, w in enumerate(words))]


def labelled() -> list[tuple[str, int]]:
    """The table as (url, unwanted 0 or 1): as many unwanted URLs as wanted ones, and as many wanted ones with made-up names,
    all with the same starts, ends and paths."""
    n = len(PARTS)
    made_up = [PARTS[i % n] + PARTS[(3 * i + i // n) % n] + PARTS[(7 * i + 2) % n] * (i % 2) for i in range(3 * len(WANTED))]
    kinds = ((_hosts(UNWANTED), 1), (_hosts(WANTED), 0), (made_up, 0))
    out = []
    for i in range(max(len(names) for names, _ in kinds)):
        start, end = f"http{'s' * (i % 2)}://{_STARTS[i % 5]}", f".{_ENDS[i % 6]}{_PATHS[i % 8]}"
        out += [(start + names[i % len(names)] + end, label) for names, label in kinds]
    return out
