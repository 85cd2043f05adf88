"""Rules, rule sets and the registry that decides which sets an item goes to.

A rule is a named SQL expression over one enriched item. A rule set rolls its
rules' results up into one result and turns that into an outcome. Both are plain
data: a new rule needs no code, and a registry can be kept in a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from cardwatch.fixed_values import (
    AMOUNT_RULE,
    APPROVED,
    CREDIT_LIMIT_RULE,
    CREDIT_RULES,
    DOUBLE_RULE_PREFIX,
    FRAUD_RULES,
    LOCATION_REASON,
    LOCATION_REJECT_AT_OR_BELOW,
    LOCATION_RULE_MEANS,
    LOCATION_RULESET,
    MERCHANT_REASON,
    MERCHANT_RULESET,
    NO_REASON,
    REJECTED_FOR_CREDIT,
    REJECTED_FOR_FRAUD,
)
from cardwatch.functions import draws, scalars

# Type of each kind of result; every verdict carries one slot per kind.
RESULT_TYPES = {"double": "double", "boolean": "boolean", "risk": "string"}


@dataclass(frozen=True)
class Rule:
    """One test of an item. A failed precondition leaves the rule not evaluated."""

    name: str
    expression: str
    category: str = FRAUD_RULES
    enabled: bool = True
    precondition: str | None = None

    def result(self) -> str:
        if self.precondition is None:
            return f"({self.expression})"
        return f"if({self.precondition}, {self.expression}, null)"

    def qualified_name(self, ruleset: str) -> str:
        return scalars.qualified_rule(self.category, ruleset, self.name)


@dataclass(frozen=True)
class RuleSet:
    """Rules, how their results combine, and when the combination rejects.

    ``rejects`` is a condition on the combined result, written ``{result}``.
    ``shared`` names columns that several rules read; they are computed once per
    item and dropped again. ``selects`` limits the set to some items.
    """

    name: str
    rules: tuple[Rule, ...]
    kind: str
    roll_up: Callable[[Sequence[str]], str]
    rejects: str
    category: str = FRAUD_RULES
    reject_status: str = REJECTED_FOR_FRAUD
    reason: str | None = None
    selects: str = "true"
    shared: Mapping[str, str] = field(default_factory=dict)
    enabled: bool = True

    @property
    def qualified_name(self) -> str:
        return scalars.qualified_ruleset(self.category, self.name)

    def add(self, rule: Rule) -> RuleSet:
        return replace(self, rules=(*self.rules, rule))

    def result(self) -> str:
        return self.roll_up([rule.result() for rule in self.rules if rule.enabled])

    def slots(self, result: str) -> str:
        """The result under the name of its kind, null under the other names."""
        return ", ".join(
            f"'result_{kind}', cast({result if kind == self.kind else 'null'} AS {kind_type})"
            for kind, kind_type in RESULT_TYPES.items()
        )

    def verdict(self, ordinal: int, result: str) -> str:
        """Result, outcome and reason as a struct; null where the set does not apply or has no result.

        A condition on a missing result (an unknown account, say) holds neither way, so
        there is no verdict and the item stays pending.
        """
        rejected = f"({self.rejects.replace('{result}', result)})"
        reason = NO_REASON if self.reason is None else self.reason
        return (
            f"if({self.selects} and {rejected} is not null, named_struct("
            f"'ordinal', {ordinal}, 'ruleset', {scalars.sql_text(self.qualified_name)}, "
            f"{self.slots(result)}, "
            f"'outcome', if({rejected}, {scalars.sql_text(self.reject_status)}, '{APPROVED}'), "
            f"'reason', if({rejected}, {scalars.sql_text(reason)}, '{NO_REASON}')), null)"
        )


class Registry:
    """Rule sets by name, in registration order.

    A set gets its number when it is registered and keeps it; the number of a deleted set is
    not given again, so columns named by it (``verdict_n``) mean the same set for ever.
    """

    def __init__(self, rule_sets: Sequence[RuleSet] = ()) -> None:
        self._sets: dict[str, RuleSet] = {}
        self._numbers: dict[str, int] = {}
        self._next = 0
        for rule_set in rule_sets:
            self.add(rule_set)

    def add(self, rule_set: RuleSet, number: int | None = None) -> None:
        if rule_set.name in self._sets:
            raise ValueError(f"rule set {rule_set.name!r} is registered already")
        number = self._next if number is None else number
        if number in self._numbers.values():
            raise ValueError(f"number {number} belongs to another rule set")
        self._sets[rule_set.name], self._numbers[rule_set.name] = rule_set, number
        self._next = max(self._next, number + 1)

    def update(self, rule_set: RuleSet) -> None:
        self.get(rule_set.name)
        self._sets[rule_set.name] = rule_set

    def delete(self, name: str) -> None:
        self.get(name)
        del self._sets[name], self._numbers[name]

    def get(self, name: str) -> RuleSet:
        if name not in self._sets:
            raise KeyError(f"no rule set {name!r}")
        return self._sets[name]

    def enable(self, name: str) -> None:
        self.update(replace(self.get(name), enabled=True))

    def disable(self, name: str) -> None:
        self.update(replace(self.get(name), enabled=False))

    def by_category(self, category: str) -> list[RuleSet]:
        return [s for s in self._sets.values() if s.category == category]

    def active(self) -> list[tuple[int, RuleSet]]:
        """Enabled sets with their registration number."""
        return [(self._numbers[name], s) for name, s in self._sets.items() if s.enabled]

    def outcomes(self) -> tuple[str, ...]:
        """Every outcome a registered set can post, approval first."""
        return tuple(dict.fromkeys((APPROVED, *(s.reject_status for s in self._sets.values()))))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per rule, and one without rule for a set that has none; ``from_df`` reads them back."""
        rows = [
            (
                self._numbers[name], place, name, s.qualified_name, s.category, s.enabled, s.kind, _roll_up_name(s.roll_up), s.rejects,
                s.reject_status, s.reason, s.selects, dict(s.shared),
                *((r.name, r.qualified_name(name), r.category, r.enabled, r.expression, r.precondition) if r else (None,) * 6),
            )
            for name, s in self._sets.items()
            for place, r in enumerate(s.rules or (None,))
        ]
        return spark.createDataFrame(rows, REGISTRY_COLUMNS)

    @classmethod
    def from_df(cls, rows: DataFrame) -> Registry:
        """The registry a table of rules describes; the table is as small as the rules are few."""
        registry = cls()
        listed = sorted(rows.collect(), key=lambda r: (r.ordinal, r.place))
        for number, group in groupby(listed, key=lambda r: r.ordinal):
            of_set = list(group)
            first = of_set[0]
            rules = tuple(
                Rule(r.rule, r.expression, r.rule_category, r.rule_enabled, r.precondition) for r in of_set if r.rule is not None
            )
            registry.add(
                RuleSet(
                    first.ruleset, rules, first.kind, ROLL_UPS[first.roll_up], first.rejects, first.category, first.reject_status,
                    first.reason, first.selects, dict(first.shared or {}), first.ruleset_enabled,
                ),
                number,
            )
        return registry


REGISTRY_COLUMNS = (
    "ordinal int, place int, ruleset string, qualified_ruleset string, category string, ruleset_enabled boolean, "
    "kind string, roll_up string, rejects string, reject_status string, reason string, selects string, "
    "shared map<string,string>, rule string, qualified_rule string, rule_category string, rule_enabled boolean, "
    "expression string, precondition string"
)


def _roll_up_name(roll_up: Callable[[Sequence[str]], str]) -> str:
    for name, known in ROLL_UPS.items():
        if known is roll_up:
            return name
    raise ValueError(f"roll-up {roll_up!r} has no name in ROLL_UPS")


# --- roll-ups -----------------------------------------------------------------

def total(results: Sequence[str]) -> str:
    """The sum, 0.0 without rules."""
    return f"({' + '.join(results) or '0.0D'})"


def worst_risk(results: Sequence[str]) -> str:
    """A HIGH, or a second MEDIUM, makes HIGH; a rule without result counts as LOW."""
    if not results:
        return "'LOW'"
    high = " OR ".join(f"{result} <=> 'HIGH'" for result in results)
    mediums = " + ".join(f"int({result} <=> 'MEDIUM')" for result in results)
    return f"CASE WHEN {high} OR {mediums} > 1 THEN 'HIGH' WHEN {mediums} = 1 THEN 'MEDIUM' ELSE 'LOW' END"


def every(results: Sequence[str]) -> str:
    """All results true, as they are without rules."""
    return " AND ".join(results) or "true"


# The names under which roll-ups are kept in a table; one's own may be added.
ROLL_UPS: dict[str, Callable[[Sequence[str]], str]] = {"total": total, "worst_risk": worst_risk, "every": every}


# --- the rules the bank runs --------------------------------------------------

def score_rule(mean: float, independent: bool = False) -> Rule:
    name = f"{DOUBLE_RULE_PREFIX}{mean}"
    normal = draws.standard_normal("id", name) if independent else "shared_normal"
    return Rule(name, draws.score(normal, mean))


def amount_rule() -> Rule:
    return Rule(AMOUNT_RULE, scalars.amount_risk("amount", "merchant.avg_txn_amount"))


def reputation_rule() -> Rule:
    return Rule(
        "ReputationRisk",
        scalars.reputation_risk("merchant.reputation"),
        precondition="merchant.id IS NOT NULL",
    )


def credit_rule() -> Rule:
    return Rule(
        CREDIT_LIMIT_RULE,
        scalars.within_credit("account.balance", "amount", "account.credit_limit"),
        category=CREDIT_RULES,
    )


def location_rules(independent: bool = False) -> RuleSet:
    return RuleSet(
        LOCATION_RULESET,
        tuple(score_rule(mean, independent) for mean in LOCATION_RULE_MEANS),
        kind="double",
        roll_up=total,
        rejects=f"{{result}} <= {LOCATION_REJECT_AT_OR_BELOW}",
        reason=LOCATION_REASON,
        shared={} if independent else {"shared_normal": draws.standard_normal("id")},
    )


def merchant_rules(*extra: Rule) -> RuleSet:
    return RuleSet(
        MERCHANT_RULESET,
        (amount_rule(), *extra),
        kind="risk",
        roll_up=worst_risk,
        rejects="{result} = 'HIGH'",
        reason=MERCHANT_REASON,
    )


def credit_rules(selects: str = "true") -> RuleSet:
    return RuleSet(
        "Credit Rules",
        (credit_rule(),),
        kind="boolean",
        roll_up=every,
        rejects="NOT {result}",
        category=CREDIT_RULES,
        reject_status=REJECTED_FOR_CREDIT,
        selects=selects,
    )


def default_registry() -> Registry:
    return Registry([location_rules(), merchant_rules()])
