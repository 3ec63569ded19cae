"""The deterministic security rules.

A rule is a function of the analysis tables that returns finding heads (one row per finding) and
references (one row per cited packet or message). Every rule covers all captures at once.

Tables: ``analyses`` (capture_id, ipsec), ``messages``, ``proposals``, ``esp``, ``ah``,
``observations``, all keyed by ``capture_id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.contract import CATEGORIES, RULES_VERSION
from flowlens.operators import dims
from flowlens.operators.findings import evidence_chunks, with_digest
from flowlens.operators.replay import (
    first_anomalies,
    replay_anomalies,
    sequence_observations,
)
from flowlens.session import store

Tables = dict[str, DataFrame]
Result = tuple[DataFrame, DataFrame]

# ---- fixed values: expected-value texts and thresholds ------------------------------------
VERIFIABLE = "A recognized algorithm such as AES_CBC or AES_GCM_16"
STRONG_ENCRYPTION = "AES_CBC, AES_CTR or AES_GCM_*"
STRONG_DH = "MODP_2048 (5/14), MODP_3072 (15), ECP_256 (19) or higher"
INIT_THRESHOLD = 20


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    finding_type: str
    severity: str
    title: str
    description: str
    impact: str
    recommendation: str
    evaluate: Callable[[Tables], Result]


def _head(
    rows: DataFrame,
    group_key: Column | str,
    source: str,
    field: str,
    item_observed: Column,
    item_expected: str,
    status: str,
    note: Column,
    observed: Column,
    expected: str,
    confidence: Column | str,
    severity: Column | str | None = None,
    finding_type: str | None = None,
) -> DataFrame:
    def column(value: Column | str | None) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return rows.select(
        "capture_id",
        column(group_key).cast("string").alias("group_key"),
        column(severity).cast("string").alias("own_severity"),
        column(finding_type).cast("string").alias("own_type"),
        column(confidence).alias("confidence"),
        F.lit(source).alias("item_source"),
        F.lit(field).alias("item_field"),
        item_observed.cast("string").alias("item_observed"),
        F.lit(item_expected).alias("item_expected"),
        F.lit(status).alias("observation_status"),
        note.alias("note"),
        observed.cast("string").alias("observed_value"),
        F.lit(expected).alias("expected_value"),
    )


def _refs(rows: DataFrame, kind: str, group_key: Column | str) -> DataFrame:
    key = group_key if isinstance(group_key, Column) else F.lit(group_key)
    return rows.select(
        "capture_id",
        key.cast("string").alias("group_key"),
        F.lit(kind).alias("kind"),
        F.col("packet_id").cast("bigint").alias("packet_id"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _counted(template: str, *columns: str) -> Column:
    return F.format_string(template, *[F.col(c) for c in columns])


def unknown_encryption(tables: Tables) -> Result:
    esp = tables["esp"].where(dims.is_unknown_encryption(F.col("encryption_algorithm")))
    proposals = tables["proposals"].where(dims.is_unknown_encryption(F.col("encryption")))
    packets = esp.groupBy("capture_id").agg(F.count("*").alias("n"))
    # distinct names: a registry of 65 536 codes bounds the set
    named = proposals.groupBy("capture_id").agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set("encryption")), ", ").alias("names"),
    )
    heads = _head(
        packets,
        "esp",
        "esp_packets",
        "encryption_algorithm",
        F.lit("UNKNOWN"),
        VERIFIABLE,
        "observed",
        _counted(
            "%d ESP packet(s) recorded without a verifiable encryption algorithm "
            "(payloads are not decrypted).",
            "n",
        ),
        F.lit("UNKNOWN"),
        VERIFIABLE,
        "high",
    ).unionByName(
        _head(
            named,
            "proposals",
            "ike_proposals",
            "encryption",
            F.col("names"),
            VERIFIABLE,
            "observed",
            _counted("%d IKE proposal(s) reference an unrecognized encryption transform id.", "n"),
            F.col("names"),
            VERIFIABLE,
            "high",
        )
    )
    return heads, _refs(esp, "packet", "esp").unionByName(_refs(proposals, "message", "proposals"))


def weak_encryption(tables: Tables) -> Result:
    observed = F.concat_ws("/", "encryption", F.col("key_length").cast("string"))
    weak = (
        tables["proposals"]
        .withColumn("weak", dims.weak_encryption_severity())
        .where("weak IS NOT NULL")
        .withColumn("observed", observed)
    )
    groups = weak.groupBy("capture_id", "observed").agg(
        F.count("*").alias("n"),
        F.max("weak").alias("weak"),
        F.bool_or(F.col("transform_confidence") == "high").alias("sure"),
    )
    heads = _head(
        groups,
        F.col("observed"),
        "ike_proposals",
        "encryption",
        F.col("observed"),
        STRONG_ENCRYPTION,
        "observed",
        _counted("%d proposal(s) affected.", "n"),
        F.col("observed"),
        STRONG_ENCRYPTION,
        F.when(F.col("sure"), "high").otherwise("medium"),
        F.col("weak"),
    )
    return heads, _refs(weak, "message", F.col("observed"))


def weak_dh(tables: Tables) -> Result:
    weak = tables["proposals"].withColumn("weak", dims.weak_dh_severity()).where("weak IS NOT NULL")
    groups = weak.groupBy("capture_id", "dh_group").agg(
        F.count("*").alias("n"), F.max("weak").alias("weak")
    )
    named = groups.withColumn("name", dims.lookup(dims.DH_GROUPS, "dh_group"))
    heads = _head(
        named,
        F.col("dh_group"),
        "ike_proposals",
        "dh_group",
        F.col("dh_group"),
        STRONG_DH,
        "observed",
        _counted("%d proposal(s) affected.", "n"),
        _counted("DH group %d (%s)", "dh_group", "name"),
        STRONG_DH,
        "high",
        F.col("weak"),
    )
    return heads, _refs(weak, "message", F.col("dh_group"))


def pfs_not_observed(tables: Tables) -> Result:
    child = tables["messages"].where(F.col("exchange_name").isin(*dims.CHILD_EXCHANGES))
    grouped_dh = (
        tables["proposals"]
        .where("dh_group IS NOT NULL")
        .join(child.select("ike_message_id"), "ike_message_id", "left_semi")
        .select("capture_id")
        .distinct()
    )
    groups = (
        child.groupBy("capture_id")
        .agg(
            F.count("*").alias("n"),
            F.bool_or(F.array_contains("payload_types", "KE")).alias("fresh"),
        )
        .where(~F.coalesce("fresh", F.lit(False)))
        .join(grouped_dh, "capture_id", "left_anti")
    )
    heads = _head(
        groups,
        "child",
        "ike_messages",
        "payload_types",
        F.lit("SA (no KE)"),
        "SA + KE (fresh DH on rekey)",
        "observed",
        _counted("%d child-SA exchange(s) without a DH/KE payload.", "n"),
        F.lit("no KE / new DH on child rekey"),
        "KE / new DH on child rekey",
        "high",
    )
    cited = child.join(groups.select("capture_id"), "capture_id", "left_semi")
    return heads, _refs(cited, "message", "child").unionByName(_refs(cited, "packet", "child"))


def incomplete_negotiation(tables: Tables) -> Result:
    setup = F.col("exchange_name").isin(*dims.SETUP_EXCHANGES)
    tunnels = tables["esp"].select("capture_id").unionByName(tables["ah"].select("capture_id"))
    groups = (
        tables["messages"]
        .groupBy("capture_id")
        .agg(
            F.count_if(setup).alias("n"),
            F.bool_or(F.col("exchange_name").isin(*dims.PROGRESS_EXCHANGES)).alias("progressed"),
        )
        .where("n > 0 AND NOT progressed")
        .join(tunnels.distinct(), "capture_id", "left_semi")
    )
    heads = _head(
        groups,
        "setup",
        "ike_messages",
        "exchange_name",
        F.lit("IKE_SA_INIT only"),
        "IKE_SA_INIT then IKE_AUTH / CREATE_CHILD_SA",
        "inferred",
        _counted(
            "%d setup exchange(s) without a later-stage message; ESP/AH traffic present in the "
            "same capture.",
            "n",
        ),
        F.lit("IKE_SA_INIT only (+ ESP/AH)"),
        "IKE_SA_INIT + IKE_AUTH",
        "medium",
    )
    cited = tables["messages"].where(setup).join(groups.select("capture_id"), "capture_id", "left_semi")
    return heads, _refs(cited, "message", "setup").unionByName(_refs(cited, "packet", "setup"))


def _selected(tables: Tables) -> DataFrame:
    return tables["proposals"].where("status = 'SELECTED'")


def unresolved_selection(tables: Tables) -> Result:
    unresolved = _selected(tables).where(
        dims.is_unresolved_transform(F.col("integrity")) | dims.is_unresolved_transform(F.col("prf"))
    )
    groups = unresolved.groupBy("capture_id").agg(F.count("*").alias("n"))
    heads = _head(
        groups,
        "unresolved",
        "ike_proposals",
        "transform_confidence",
        F.lit("unresolved integrity/PRF"),
        "resolved transform values",
        "observed",
        _counted("%d selected proposal(s) contain unresolved transform attributes.", "n"),
        _counted("%d unresolved selected proposal(s)", "n"),
        "all selected transforms resolved",
        "medium",
    )
    return heads, _refs(unresolved, "message", "unresolved")


def conflicting_groups(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Selected proposals with their SA key, and the SAs selected more than once.

    The SA key comes from the proposal's message (left join; no message gives an empty key).
    """
    spis = tables["messages"].select(
        "ike_message_id", F.concat_ws(":", "initiator_spi", "responder_spi").alias("sa_key")
    )
    keyed = _selected(tables).join(spis, "ike_message_id", "left").withColumn(
        "sa_key", F.coalesce("sa_key", F.lit(""))
    )
    conflicts = (
        keyed.groupBy("capture_id", "protocol_name", "sa_key")
        .agg(F.count("*").alias("selections"))
        .where("selections > 1")
    )
    return keyed, conflicts


def conflicting_selection(tables: Tables) -> Result:
    keyed, conflicts = conflicting_groups(tables)
    groups = conflicts.groupBy("capture_id").agg(F.count("*").alias("n"))
    heads = _head(
        groups,
        "conflicting",
        "ike_proposals",
        "status",
        F.lit("multiple SELECTED proposals per SA"),
        "exactly one SELECTED proposal per SA",
        "inferred",
        _counted("%d SA(s) with conflicting selections.", "n"),
        F.lit("conflicting SELECTED proposals"),
        "single SELECTED proposal per SA",
        "low",
        "high",
        "vulnerability_indicator",
    )
    keys = ["capture_id", "protocol_name", "sa_key"]
    return heads, _refs(keyed.join(conflicts.select(*keys), keys, "left_semi"), "message", "conflicting")


def selected_sa(tables: Tables) -> Result:
    a, b = unresolved_selection(tables), conflicting_selection(tables)
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])


def replay(tables: Tables) -> Result:
    # stored: the scan runs in Python, and counts, values and references all read it
    reported = store(
        replay_anomalies(sequence_observations(tables["esp"], tables["ah"])), "anomalies"
    )
    keys = ["capture_id", "source_table"]
    ranked = F.array_sort(F.collect_list(F.struct("position", "sequence_number")))
    first = first_anomalies(reported).groupBy(*keys).agg(ranked.alias("ranked"))
    groups = reported.groupBy(*keys).agg(F.count("*").alias("n")).join(first, keys)
    shown = F.array_join(F.col("ranked.sequence_number").cast("array<string>"), ", ")
    heads = _head(
        groups,
        F.col("source_table"),
        "",
        "sequence_number",
        shown,
        "strictly increasing per (SPI, direction)",
        "inferred",
        _counted(
            "%d non-increasing sequence observation(s); out-of-order delivery cannot be excluded.",
            "n",
        ),
        _counted("%d non-increasing sequence(s)", "n"),
        "strictly increasing sequence numbers",
        "medium",
    ).withColumn("item_source", F.col("group_key"))
    return heads, _refs(reported, "packet", F.col("source_table"))


def dual_protection(tables: Tables) -> Result:
    keys = ["capture_id", "spi", "direction"]
    shared = tables["esp"].select(*keys).intersect(tables["ah"].select(*keys))
    # the finding names every shared SA; they are sorted and joined per SPI range, then in range
    # order, so the sort of one capture is spread
    entry = F.concat_ws("/", "spi", "direction")
    ranges = shared.groupBy("capture_id", F.substring("spi", 1, 2).alias("range")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("part")
    )
    ordered = F.array_sort(F.collect_list(F.struct("range", "part")))
    groups = ranges.groupBy("capture_id").agg(F.sum("n").alias("n"), ordered.alias("parts"))
    listed = F.array_join(F.col("parts.part"), ", ")
    heads = _head(
        groups,
        "shared",
        "ah_packets",
        "spi",
        listed,
        "no SPI shared with ESP",
        "observed",
        _counted("%d SA(s) carry both ESP and AH.", "n"),
        _counted("%d SA(s) with ESP + AH", "n"),
        "single protection layer per SA",
        "high",
    )
    return heads, _refs(tables["esp"].join(shared, keys, "left_semi"), "packet", "shared")


def plaintext_beside_ipsec(tables: Tables, exclude_carrier: bool = False) -> Result:
    """Plaintext protocols of captures that contain IPsec.

    UDP is counted for IKE packets too, so a capture of IKE alone is reported by default;
    ``exclude_carrier`` subtracts the packets that carry IKE.
    """
    detected = tables["analyses"].where("ipsec = 'yes'").select("capture_id")
    observed = tables["observations"]
    if exclude_carrier:
        carried = observed.where("protocol = 'ike'").select(
            "capture_id", F.col("packet_count").alias("carried"), F.lit("udp").alias("protocol")
        )
        left = F.col("packet_count") - F.coalesce("carried", F.lit(0))
        observed = (
            observed.join(carried, ["capture_id", "protocol"], "left")
            .withColumn("packet_count", left)
            .where("packet_count > 0")
        )
    plain = observed.where(dims.is_plaintext_protocol(F.col("protocol"))).join(
        detected, "capture_id", "left_semi"
    )
    entries = F.array_sort(F.collect_list(F.struct("protocol", "packet_count")))
    groups = plain.groupBy("capture_id").agg(entries.alias("entries"))
    names = F.array_join(F.col("entries.protocol"), ", ")
    counts = F.array_join(
        F.transform(
            "entries", lambda e: F.concat_ws("=", e["protocol"], e["packet_count"].cast("string"))
        ),
        ", ",
    )
    heads = _head(
        groups,
        "plaintext",
        "protocol_observations",
        "protocol",
        names,
        "IPsec protocols only",
        "observed",
        F.concat(F.lit("Plaintext protocols with packet counts: "), counts),
        names,
        "IPsec protocols only",
        "high",
    )
    return heads, _refs(tables["messages"].where("false"), "packet", "plaintext")


def initiation_frequency(tables: Tables, threshold: int = INIT_THRESHOLD) -> Result:
    setup = tables["messages"].where(F.col("exchange_name").isin(*dims.SETUP_EXCHANGES))
    pair = ["capture_id", "source_ip", "destination_ip"]
    groups = setup.groupBy(*pair).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    key = F.concat_ws(">", "source_ip", "destination_ip")
    observed = _counted("%d initiations from %s to %s", "n", "source_ip", "destination_ip")
    heads = _head(
        groups,
        key,
        "ike_messages",
        "exchange_name",
        _counted("%d setup requests", "n"),
        f"< {threshold} setup requests",
        "inferred",
        F.concat(
            observed, F.lit(f"; threshold is {threshold} setup requests from one endpoint.")
        ),
        observed,
        f"< {threshold} initiations per endpoint",
        "medium",
    )
    return heads, _refs(setup.join(groups.select(*pair), pair, "left_semi"), "message", key)


RULES: tuple[Rule, ...] = (
    Rule(
        "IPSEC-CRYPTO-001",
        "VISIBILITY",
        "informational",
        "low",
        "Encryption could not be verified from the capture",
        "Some ESP traffic or IKE proposals name no cipher that can be read from the capture.",
        "How strongly this traffic is encrypted cannot be told from the capture.",
        "Check the negotiated cipher on the gateway.",
        unknown_encryption,
    ),
    Rule(
        "IPSEC-CRYPTO-002",
        "CRYPTOGRAPHY",
        "vulnerability_indicator",
        "medium",
        "Weak encryption algorithm in use",
        "A proposal offers or selects a cipher from the fixed list of weak ones.",
        "Traffic under this cipher can be decrypted with realistic effort, or is not encrypted.",
        "Offer AES with at least 128 bits and drop the old ciphers.",
        weak_encryption,
    ),
    Rule(
        "IPSEC-DH-001",
        "KEY_EXCHANGE",
        "vulnerability_indicator",
        "medium",
        "Weak Diffie-Hellman group in use",
        "A proposal offers or selects a Diffie-Hellman group below 2048 bits.",
        "The key exchange is open to precomputation attacks.",
        "Use group 14 or stronger and drop the weak groups.",
        weak_dh,
    ),
    Rule(
        "IPSEC-PFS-001",
        "PFS",
        "policy_deviation",
        "medium",
        "Perfect forward secrecy not observed for child SAs",
        "Child SAs were negotiated in view of the capture without a new key exchange.",
        "A leaked long-term key would expose the traffic of every child SA.",
        "Require a key exchange whenever a child SA is created or rekeyed.",
        pfs_not_observed,
    ),
    Rule(
        "IPSEC-IKE-001",
        "PROTOCOL",
        "configuration_risk",
        "low",
        "IKE negotiation may be incomplete",
        "Setup exchanges and tunnel traffic are visible, but no later IKE exchange is.",
        "The capture is partial or the negotiation was interrupted.",
        "Capture the negotiation from its start to its authentication.",
        incomplete_negotiation,
    ),
    Rule(
        "IPSEC-SA-001",
        "SECURITY_ASSOCIATION",
        "configuration_risk",
        "medium",
        "Selected security association could not be fully verified",
        "A selected proposal has unreadable transforms, or one SA has several selections.",
        "What protects this SA is uncertain.",
        "Compare with the parameters in force on the gateway.",
        selected_sa,
    ),
    Rule(
        "IPSEC-REPLAY-001",
        "REPLAY_PROTECTION",
        "vulnerability_indicator",
        "medium",
        "Non-increasing ESP/AH sequence numbers observed",
        "Sequence numbers of an SA repeat or fall; reordering on the way looks the same.",
        "Packets may have been replayed, duplicated or reordered.",
        "Look at the receiver's anti-replay counters for the cited packets.",
        replay,
    ),
    Rule(
        "IPSEC-COMPOSITE-001",
        "SECURITY_ASSOCIATION",
        "informational",
        "info",
        "ESP and AH both applied to the same security association",
        "The same SPI and direction carries ESP and AH packets.",
        "Every packet pays for two protection layers.",
        "Confirm that the policy asks for both.",
        dual_protection,
    ),
    Rule(
        "IPSEC-META-001",
        "METADATA",
        "informational",
        "info",
        "Non-IPsec traffic observed alongside IPsec",
        "The capture holds IPsec and other protocols side by side.",
        "The other traffic can be read by whoever holds the capture.",
        "Restrict the capture to IPsec if that matters.",
        plaintext_beside_ipsec,
    ),
    Rule(
        "IPSEC-META-002",
        "METADATA",
        "informational",
        "info",
        "Elevated IKE initiation frequency observed",
        "One endpoint sent many setup requests to the same peer.",
        "The pattern shows client churn, misconfiguration or probing to an observer.",
        "Check the initiating endpoint.",
        initiation_frequency,
    ),
)


def check_registry(rules: tuple[Rule, ...] = RULES) -> None:
    ids = [rule.rule_id for rule in rules]
    if len(ids) != len(set(ids)):
        raise ValueError("duplicate rule id")
    for rule in rules:
        if not rule.rule_id.startswith("IPSEC-") or rule.category not in CATEGORIES:
            raise ValueError(f"bad rule {rule.rule_id}")


check_registry()


def evaluate_rule(rule: Rule, tables: Tables) -> Result:
    heads, refs = rule.evaluate(tables)
    described = heads.select(
        "capture_id",
        F.lit(rule.rule_id).alias("rule_id"),
        "group_key",
        F.lit(RULES_VERSION).alias("rule_version"),
        F.lit(rule.title).alias("title"),
        F.coalesce("own_severity", F.lit(rule.severity)).alias("severity"),
        F.coalesce("own_type", F.lit(rule.finding_type)).alias("finding_type"),
        F.lit(rule.category).alias("category"),
        F.lit(rule.description).alias("description"),
        F.lit(rule.impact).alias("impact"),
        F.lit(rule.recommendation).alias("recommendation"),
        *[c for c in heads.columns if c not in ("capture_id", "group_key", "own_severity", "own_type")],
    )
    return described, refs.withColumn("rule_id", F.lit(rule.rule_id))


def evaluate_rules(tables: Tables, rules: tuple[Rule, ...] = RULES) -> Result:
    """Findings with digests, and their evidence chunks, over all captures."""
    results = [evaluate_rule(rule, tables) for rule in rules]
    chunks = evidence_chunks(_union([refs for _, refs in results]))
    findings = with_digest(_union([heads for heads, _ in results]), chunks)
    return findings.withColumn("status", F.lit("open")), chunks
