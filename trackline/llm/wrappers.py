"""Union-free expressions inferred from the pages of one host.

A template is the sequence of a page's elements, element inside element. Aligning two templates walks both sequences:
an element that stands further ahead in the other makes those between optional, one that stands further back starts
a repeated group, one that the other lacks becomes an optional member at that place. A repeated group may leave out any
of its members, so each kind of element has one member per parent, however many pages went in. The texts of a
member that all its pages share are template; a member whose texts differ holds a slot.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

from trackline.llm.pages import BLOCK, Page

CONTAINERS = frozenset("html body main div section article center table tbody tr td".split())
# Blocks that name what stands beside or below them: their text may be the same on all pages of a host.
LABELS = frozenset("h1 h2 h3 h4 h5 h6 dt dd th td caption legend figcaption summary".split())
DISTINCT = 5  # different pages that must share a text at one place before it counts as part of the template
MOST = 0.6  # share of the running text that the element around the article holds
ENOUGH = 1 / 3  # the same for an element that holds all titles and paragraphs there are


class Member:
    """One member of a template: an element with the members inside it and what its pages have as its own text."""

    __slots__ = (
        "key", "repeated", "joined", "pages", "flags", "chars", "slot", "texts", "seen", "members", "size", "main", "fixed"
    )

    def __init__(self, key: str, repeated=False, joined=False, pages=1, flags=0, chars=0, slot=False, texts=(), seen=()):
        self.key, self.repeated, self.pages, self.flags = key, repeated, pages, flags
        self.joined = joined  # in one repeated group with the member before it
        self.chars = chars  # of running text, links left out
        self.slot = slot  # some page had a text here that another had not
        self.texts: dict[int, int] = dict(texts)  # checksum and running characters of the texts all pages share
        self.seen = set(seen)  # checksums of up to DISTINCT pages
        self.members: dict[str, Member] = {}

    @property
    def shared(self) -> dict[int, int]:
        return self.texts if len(self.seen) >= DISTINCT else {}

    def data(self) -> list:
        """All members in page order, each with the number of its parent."""
        out, stack = [], [(self, -1)]
        while stack:
            m, parent = stack.pop()
            number = len(out)
            out.append([
                parent, m.key, int(m.repeated), int(m.joined), m.pages, m.flags, m.chars, int(m.slot),
                sorted(m.texts.items()), sorted(m.seen),
            ])
            stack += [(k, number) for k in reversed(m.members.values())]
        return out

    @staticmethod
    def of(data: list) -> "Member":
        made: list[Member] = []
        for parent, key, repeated, joined, *rest in data:
            made.append(Member(key, bool(repeated), bool(joined), *rest))
            if parent >= 0:
                made[parent].members[key] = made[-1]
        return made[0]

    def expression(self) -> str:
        """The union-free expression: ``?`` after an optional member, ``+`` after a repeated one or group, ``*`` a slot."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            m = stack.pop()
            if isinstance(m, str):
                out.append(m)
                continue
            out.append("<" + m.key + ">" + ("*" if m.slot or m.texts and not m.shared else ""))
            kids = list(m.members.values())
            todo: list = []
            for i, k in enumerate(kids):
                more = i + 1 < len(kids) and kids[i + 1].joined
                todo += ["("] if more and not k.joined else []
                todo += [k, "+" if k.repeated and not k.joined and not more else "?" if k.pages < m.pages else ""]
                todo += [")+"] if k.joined and not more else []
            stack += reversed([*todo, "</>"])
        return "".join(out)


def absorb(a: Member, b: Member, same_page: bool) -> None:
    """The counts and texts of ``b`` into ``a``."""
    a.repeated |= b.repeated or same_page
    a.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    a.chars += b.chars
    a.flags |= b.flags
    a.slot |= b.slot
    if same_page:
        a.texts.update(b.texts)
    elif a.texts.keys() != b.texts.keys():
        a.slot = True
        a.texts = {t: n for t, n in a.texts.items() if t in b.texts}
    a.seen = set(sorted(a.seen | b.seen)[:DISTINCT])


def align(a: Member, b: Member, same_page: bool) -> Member:
    """``a`` with ``b`` merged in; of the same page, the two are repetitions of one member."""
    todo = [(a, b)]
    while todo:
        one, two = todo.pop()
        absorb(one, two, same_page)
        order = list(one.members)
        rank = {k: i for i, k in enumerate(order)}
        at, late = -1, {}
        for key, member in two.members.items():
            if key not in rank:
                late.setdefault(at, []).append(member)
                continue
            found = rank[key]
            if at >= 0 and (found < at or member.joined):
                join(one.members, order, min(at, found), max(at, found))
            at = found
            todo.append((one.members[key], member))
        if late:
            one.members = {m.key: m for m in placed(one, order, late)}
    return a


def join(members: dict[str, Member], order: list[str], first: int, last: int) -> None:
    """One repeated group out of the members from ``first`` to ``last``."""
    for i in range(first, last + 1):
        members[order[i]].repeated = True
        members[order[i]].joined |= i > first


def placed(parent: Member, order: list[str], late: dict[int, list[Member]]) -> Iterator[Member]:
    """The parent's members with those it lacked, each behind the one that it follows on its own page."""
    for i in range(-1, len(order)):
        if i >= 0:
            yield parent.members[order[i]]
        inner = i >= 0 and i + 1 < len(order) and parent.members[order[i + 1]].joined
        for new in late.get(i, ()):
            new.joined |= inner
            new.repeated |= new.joined
            yield new


def runs(page: Page, skipped: list[bool] | None = None) -> Iterator[tuple[int, str, int]]:
    """(block element, text, characters outside links) of each block of a page, without the elements ``skipped``.

    Inline elements beside the article (buttons and the like) are left out of the block they stand in.
    """
    block, link, out = [0], [False], [False]
    for i in range(1, len(page.tags)):
        up, own = page.parents[i], page.tags[i] in BLOCK
        block.append(i if own else block[up])
        link.append(not own and link[up] or page.tags[i] == "a")
        out.append(not own and (out[up] or page.side[i]))
    texts: list[str] = []
    place, running = None, 0
    for node, text in [*page.events, (0, None)]:
        if text is None:
            words = " ".join("".join(texts).split())
            if words:
                yield place, words, min(running, len(words))
            texts, place, running = [], None, 0
        elif not out[node] and not (skipped and skipped[node]):
            texts.append(text)
            size = len("".join(text.split()))
            if size and place is None:
                place = block[node]
            running += 0 if link[node] else size


def checksum(words: str) -> int:
    return zlib.crc32(words.encode("utf-8", "replace"))


def template(page: Page) -> Member:
    """The template of one page alone."""
    nodes = [Member(k, flags=s + 2 * m) for k, s, m in zip(page.keys, page.side, page.main)]
    kids: list[list[int]] = [[] for _ in nodes]
    for i in range(1, len(nodes)):
        kids[page.parents[i]].append(i)
    mark = checksum("\n".join(t for _, t in page.events if t))
    for node in nodes:
        node.seen = {mark}
    for place, words, running in runs(page):
        node = nodes[place]
        node.chars += running
        if words.endswith(":"):
            node.slot = True  # a label of what follows
        else:
            node.texts[checksum(words)] = running
    # Children before parents, so that repetitions meet complete.
    for i in range(len(nodes) - 1, -1, -1):
        members: dict[str, Member] = {}
        rank: dict[str, int] = {}
        order: list[str] = []
        at, joined = -1, (0, -1)  # joined: the span that is known to be one group
        for kid in kids[i]:
            key = nodes[kid].key
            if key not in members:
                members[key], rank[key] = nodes[kid], len(order)
                order.append(key)
                if at >= 0 and at < len(order) - 2:
                    join(members, order, at, len(order) - 1)
            else:
                align(members[key], nodes[kid], True)
                if rank[key] < at and not joined[0] <= rank[key] <= at <= joined[1]:
                    joined = (rank[key], at)
                    join(members, order, *joined)
            at = rank[key]
        nodes[i].members = members
    return nodes[0]


def merged(templates: Iterable[Member]) -> Member | None:
    out = None
    for one in templates:
        out = one if out is None else align(out, one, False)
    return out


def is_container(member: Member) -> bool:
    return member.key.split(".")[0] in CONTAINERS


def measure(root: Member) -> None:
    """Sets, from the leaves up: running text in slots, whether an article lies inside, whether there is no slot at all."""
    order, stack = [], [root]
    while stack:
        m = stack.pop()
        order.append(m)
        stack += m.members.values()
    for m in reversed(order):
        kids = list(m.members.values())
        own = max(0, m.chars - m.pages * sum(m.shared.values()))
        m.size = own + sum(k.size for k in kids if not k.flags & 1)
        m.main = any(k.flags & 2 and not k.flags & 1 or k.main and is_container(k) and "comment" not in k.key for k in kids)
        m.fixed = not m.slot and len(m.seen) >= DISTINCT and all(k.fixed for k in kids)


def main_path(root: Member) -> tuple[list[str], bool]:
    """Keys from the page down to the member that holds the article, and whether the markup itself says so."""
    measure(root)
    best, found = -1, None
    stack = [(root, (root.key, None))]  # paths as links to the parent's, so that depth costs nothing
    while stack:
        member, path = stack.pop()
        beside = bool(member.flags & 1) and member is not root
        if member.flags & 2 and not beside:
            if member.size > best:
                best, found = member.size, (member, path)
            continue  # an article inside it belongs to it
        if not beside or member.main and is_container(member) and "comment" not in member.key:
            stack += [(m, (m.key, path)) for m in reversed(member.members.values())]
    if found:
        # An element around the article and more is narrowed down to the article.
        member, path = found
        return [*keys_of(path), *inner_article(member)], True
    member, keys = root, [root.key]
    while member.size:
        heavy = [m for m in member.members.values() if is_container(m) and not m.flags & 1 and m.size > MOST * member.size]
        if not heavy or heavy[0].repeated or "h1" in member.members:
            break
        member = heavy[0]
        keys.append(member.key)
    return keys, False


def keys_of(path: tuple | None) -> list[str]:
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return out[::-1]


def inner_article(member: Member) -> list[str]:
    """Keys below ``member`` to a single article inside it that holds most of its text; none if there is no such."""
    total, keys, sure = member.size, [], 0
    while total:
        heavy = [m for m in member.members.values() if not m.flags & 1 and not m.repeated and m.size > MOST * total]
        if not heavy or not (heavy[0].flags & 2 or is_container(heavy[0])):
            break
        member = heavy[0]
        keys.append(member.key)
        if member.flags & 2:
            sure = len(keys)
    return keys[:sure]


def trail(parent: int, key: str) -> int:
    """Number of a place below the article."""
    return zlib.crc32(key.encode("utf-8", "replace"), parent)


def fixed_texts(root: Member, path: list[str]) -> dict[str, list[int]]:
    """Place to checksums of the texts inside the article that all pages share there: menus and notices of the host.

    What names its neighbours (``LABELS``) stays unless the element around it holds no slot at all.
    """
    member = root
    for key in path[1:]:
        member = member.members[key]
    out: dict[str, list[int]] = {}
    stack = [(member, 0, False)]
    while stack:
        node, place, closed = stack.pop()
        tag = node.key.split(".")[0]
        if node.shared and (closed or tag not in LABELS):
            out.setdefault(str(place), []).extend(sorted(node.shared))
        for m in node.members.values():
            group = m.fixed and m.key.split(".")[0] not in LABELS
            stack.append((m, trail(place, m.key), closed or group))
    return out


def wrapper(root: Member) -> str:
    path, marked = main_path(root)
    return json.dumps([path, marked, fixed_texts(root, path)])


def article(page: Page, rules: list | None) -> str | None:
    """The text at the wrapper's place, block by block; None if the page has no such place.

    Where the markup names the article, shared texts that make up over half of it are the article of near copies and
    stay. Where it does not, lists of nothing but links go, and the place is narrowed to the element with most text.
    """
    path, marked, fixed = rules if rules else json.loads(wrapper(template(page)))
    want = len(path) - 1
    # depth on the wrapper's path, -1 off it; out: outside the article, or beside it though below it
    depth, out, place, tops = [0], [want > 0], [0], [0] if want == 0 else []
    for i in range(1, len(page.tags)):
        parent = page.parents[i]
        on_path = 0 <= depth[parent] < want and page.keys[i] == path[depth[parent] + 1]
        depth.append(depth[parent] + 1 if on_path else -1)
        if on_path and depth[i] == want:
            tops.append(i)
            out.append(False)
            place.append(0)
        else:
            own_head = page.tags[i] == "header" and (marked or page.tags[parent] not in ("#page", "html", "body"))
            out.append(out[parent] or page.side[i] and not own_head)
            place.append(0 if out[i] else trail(place[parent], page.keys[i]))
    if not tops:
        return None
    blocks = list(runs(page, out))
    shared = [checksum(words) in fixed.get(str(place[node]), ()) for node, words, _ in blocks]
    if marked and 2 * sum(len(b[1]) for b, s in zip(blocks, shared) if s) > sum(len(b[1]) for b in blocks):
        shared = [False] * len(blocks)
    kept = [b for b, s in zip(blocks, shared) if not s]
    if not marked:
        kept = narrowed(page, kept, tops)
    return "\n".join(words for _, words, _ in kept)


def narrowed(page: Page, blocks: list[tuple[int, str, int]], tops: list[int]) -> list[tuple[int, str, int]]:
    """The blocks without lists of links, and of the single element that holds most running text under a title."""
    n = len(page.tags)
    running, links, rich = [0] * n, [0] * n, [0] * n
    for node, words, size in blocks:
        running[node] += size
        links[node] += 0 if size else 1
        rich[node] += 2 if page.tags[node] in ("h1", "h2") else page.tags[node] == "p"
    if not any(running):
        return blocks
    for i in range(n - 1, 0, -1):
        for counts in (running, links, rich):
            counts[page.parents[i]] += counts[i]
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[page.parents[i]] or page.tags[i] in ("ul", "ol") and not running[i] and links[i] > 1
    if len(tops) == 1:
        at, titled = tops[0], set()
        kids: dict[int, list[int]] = {}
        for i in range(1, n):
            kids.setdefault(page.parents[i], []).append(i)
            if page.tags[i] == "h1":
                titled.add(page.parents[i])
        while at not in titled:
            heavy = [
                k for k in kids.get(at, ()) if page.tags[k] in CONTAINERS and rich[k] > 1
                and running[k] > (ENOUGH if rich[k] > 2 and rich[k] == rich[at] else MOST) * running[at]
            ]
            if not heavy:
                break
            at = heavy[0]
        keep = [False] * n
        for i in range(n):
            keep[i] = i == at or i > 0 and keep[page.parents[i]]
        gone = [g or not k for g, k in zip(gone, keep)]
    return [b for b in blocks if not gone[b[0]]]
