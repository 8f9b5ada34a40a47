"""Which source profile a table's headers satisfy: literal aliases only, nothing is guessed."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tendersift.sources import archive
from tendersift.sources.archive import ALIASES, REQUIRED, ArchiveError, Budget, normalized_header
from tendersift.sources.manifest import digest


@dataclass(frozen=True)
class Profile:
    """Canonical fields with the headers that may hold them, and the fields that must be there."""

    name: str
    aliases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ALIASES))
    required: tuple[str, ...] = REQUIRED


@dataclass(frozen=True)
class HeaderReport:
    profile: str
    bindings: dict[str, tuple[str, ...]]
    missing: tuple[str, ...]
    unrecognized: tuple[str, ...]
    redundant: tuple[str, ...]

    @property
    def compatible(self) -> bool:
        return not self.missing


def inspect(headers: list[str], profile: Profile) -> HeaderReport:
    """What of a profile the headers bind; blank headers and headers that normalize alike are errors."""
    names = [normalized_header(h) for h in headers]
    if not all(names) or len(set(names)) < len(names):
        raise ArchiveError("blank or repeated headers")
    there = dict(zip(names, (h.strip() for h in headers), strict=True))
    known = {f: [normalized_header(a) for a in aliases] for f, aliases in profile.aliases.items()}
    bindings = {f: tuple(there[a] for a in aliases if a in there) for f, aliases in known.items() if not there.keys().isdisjoint(aliases)}
    used = {a for aliases in known.values() for a in aliases}
    return HeaderReport(
        profile.name,
        bindings,
        tuple(f for f in profile.required if f not in bindings),
        tuple(h for n, h in there.items() if n not in used),
        tuple(f for f, bound in bindings.items() if len(bound) > 1),
    )


def resolve(headers: list[str], profiles: list[Profile], name: str | None = None, allow_unrecognized: bool = True) -> HeaderReport:
    """The report of the named profile, or of the only one that the headers satisfy; none or several are errors."""
    asked = [p for p in profiles if name is None or p.name.casefold() == name.strip().casefold()]
    fits = [r for r in (inspect(headers, p) for p in asked) if r.compatible]
    if len(fits) != 1:
        raise ArchiveError("no profile fits" if not fits else f"several profiles fit, name one: {', '.join(r.profile for r in fits)}")
    if fits[0].unrecognized and not allow_unrecognized:
        raise ArchiveError(f"headers outside the profile: {', '.join(fits[0].unrecognized)}")
    return fits[0]


@dataclass(frozen=True)
class LoadPlan:
    """The sha256 of an archive, the header report of each member to load, and the members left out."""

    sha256: str
    members: tuple[tuple[str, HeaderReport], ...]
    ignored: tuple[str, ...]

    def digest(self) -> str:
        return digest(asdict(self))


def planned(path: str, profiles: list[Profile], name: str | None = None, members: tuple[str, ...] | None = None, allow_unrecognized: bool = True, allow_mixed: bool = False, budget: Budget = Budget()) -> LoadPlan:
    """The plan of loading the named members of an archive, or all; members of different profiles are an error unless allowed."""
    found = archive.raw_headers(path, budget)
    if unknown := set(members or ()) - set(found):
        raise ArchiveError(f"no such members: {', '.join(sorted(unknown))}")
    chosen = tuple((m, resolve(heads, profiles, name, allow_unrecognized)) for m, heads in found.items() if members is None or m in members)
    if not chosen:
        raise ArchiveError("the archive holds no table")
    if len({r.profile for _, r in chosen}) > 1 and not allow_mixed:
        raise ArchiveError("members of several profiles")
    return LoadPlan(archive.sha256_of(path), chosen, tuple(m for m in found if m not in {c for c, _ in chosen}))


def loaded(spark: SparkSession, path: str, plan: LoadPlan, profiles: list[Profile], budget: Budget = Budget()) -> DataFrame:
    """The canonical rows of a plan with their outcomes; an error if the archive is another by now."""
    whole = None
    for profile in profiles:
        mine = tuple(m for m, r in plan.members if r.profile == profile.name)
        if mine:
            aliases = {f: () for f in ALIASES} | {f: tuple(map(normalized_header, a)) for f, a in profile.aliases.items()}
            rows = archive.adapted(archive.read_archive(spark, path, budget, members=mine, sha256=plan.sha256), profile.name, aliases)
            whole = rows if whole is None else whole.unionByName(rows)
    return archive.outcomes(whole)
