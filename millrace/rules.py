"""Rule configuration: phrase lists and numbers that the operators take.

The values are examples of this library's own; every operator takes a
``Rules`` and none has values built in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from millrace.functions.money import RATES


@dataclass(frozen=True)
class Rules:
    # titles
    exclude_keywords: tuple[str, ...] = ("intern", "contract")
    exclude_roles: tuple[str, ...] = ()
    exclude_anywhere: tuple[str, ...] = ()
    allow_phrases: tuple[str, ...] = ()
    exclude_functions: tuple[str, ...] = ()
    include_keywords: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    exclude_employment: tuple[str, ...] = ()
    # places
    open_terms: tuple[str, ...] = ("worldwide", "anywhere", "global")
    restricted_terms: tuple[str, ...] = ("US", "USA", "UK", "EU", "europe", "canada")
    generic_words: tuple[str, ...] = ("remote", "remotely", "fully", "work from home", "wfh", "flexible", "anywhere", "or", "and")
    hub_cities: tuple[str, ...] = ("bangalore",)
    place_aliases: dict[str, str] = field(default_factory=lambda: {"bengaluru": "bangalore"})
    hub_centres_only: bool = True
    # companies
    centre_seeds: tuple[str, ...] = ()
    centre_keywords: tuple[str, ...] = ("global capability centre", "gcc")
    blocked: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()
    # numbers
    posted_within_days: int = 14
    min_salary_usd: float = 50_000.0
    min_salary_inr: float | None = None
    rates: dict[str, float] = field(default_factory=lambda: dict(RATES))
    max_shortlist: int = 100
    weights: dict[str, float] = field(default_factory=lambda: {"skills": 40, "seniority": 20, "location": 15, "salary": 15, "company": 10})
    min_score: int = 0
    top_count: int = 5
    extra_count: int = 10
