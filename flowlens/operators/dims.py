"""Code-to-name dictionaries and weak-algorithm tables.

They are fixed vocabularies of a few dozen entries each, so a lookup is a literal map inside the
projection: nothing is shuffled or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: IKE registries --------------------------------------------------------
IKEV2_EXCHANGES = {
    34: "IKE_SA_INIT",
    35: "IKE_AUTH",
    36: "CREATE_CHILD_SA",
    37: "INFORMATIONAL",
    38: "IKE_SESSION_RESUME",
}
IKEV1_EXCHANGES = {
    0: "NONE",
    1: "BASE",
    2: "IDENTITY_PROTECTION",
    3: "AUTHENTICATION_ONLY",
    4: "AGGRESSIVE",
    5: "INFORMATIONAL",
    6: "NEW_GROUP_MODE",
    7: "QUICK_MODE",
}
IKEV2_PAYLOADS = {
    0: "NONE",
    33: "SA",
    34: "KE",
    35: "IDi",
    36: "IDr",
    37: "CERT",
    38: "CERTREQ",
    39: "AUTH",
    40: "NONCE",
    41: "NOTIFY",
    42: "DELETE",
    43: "VENDOR_ID",
    44: "TSi",
    45: "TSr",
    46: "SK",
    47: "CP",
    48: "EAP",
    51: "GSA",
}
IKEV1_PAYLOADS = {
    0: "NONE",
    1: "SA",
    2: "PROPOSAL",
    3: "TRANSFORM",
    4: "KE",
    5: "ID",
    6: "CERT",
    7: "CERTREQ",
    8: "HASH",
    9: "SIG",
    10: "NONCE",
    11: "NOTIFY",
    12: "DELETE",
    13: "VENDOR_ID",
    19: "NAT_D",
    20: "NAT_OA",
}
IKEV2_PROTOCOLS = {1: "IKE", 2: "AH", 3: "ESP"}
IKEV1_PROTOCOLS = {1: "ISAKMP", 2: "AH", 3: "ESP"}
ENCRYPTION = {
    1: "DES",
    2: "3DES",
    3: "RC5",
    4: "IDEA",
    5: "CAST",
    6: "BLOWFISH",
    7: "3IDEA",
    8: "DES_IV64",
    9: "DES_IV32",
    11: "NULL",
    12: "AES_CBC",
    13: "AES_CTR",
    14: "AES_CCM_8",
    15: "AES_CCM_12",
    16: "AES_CCM_16",
    18: "AES_GCM_16",
    19: "AES_GCM_12",
    20: "AES_GCM_8",
    22: "AES_CBC_192",
    23: "AES_CBC_256",
    24: "AES_CTR_192",
    25: "AES_CTR_256",
}
INTEGRITY = {
    0: "NONE",
    1: "HMAC_MD5_96",
    2: "HMAC_SHA1_96",
    3: "HMAC_TIGER",
    4: "AES_XCBC_96",
    5: "HMAC_SHA2_256_128",
    6: "HMAC_SHA2_384_192",
    7: "HMAC_SHA2_512_256",
    8: "HMAC_SHA2_256_TRUNC128",
    9: "AES_CMAC_96",
    10: "AES_128_GMAC",
    11: "AES_192_GMAC",
    12: "AES_256_GMAC",
}
PRF = {
    1: "HMAC_MD5",
    2: "HMAC_SHA1",
    3: "HMAC_TIGER",
    4: "AES128_XCBC",
    5: "HMAC_SHA2_256",
    6: "HMAC_SHA2_384",
    7: "HMAC_SHA2_512",
    8: "AES128_CMAC",
}
DH_GROUPS = {
    1: "MODP_768",
    2: "MODP_1024",
    3: "MODP_1536",
    5: "MODP_2048",
    7: "MODP_163",
    8: "MODP_??",
    9: "MODP_??",
    14: "MODP_2048",
    15: "MODP_3072",
    16: "MODP_4096",
    17: "MODP_6144",
    18: "MODP_8192",
    19: "ECP_256",
    20: "ECP_384",
    21: "ECP_521",
    22: "MODP_1024_S160",
    23: "MODP_2048_S224",
    24: "MODP_2048_S256",
    25: "ECP_192",
    26: "ECP_224",
    27: "BRAINPOOL_P256",
    28: "BRAINPOOL_P384",
    29: "BRAINPOOL_P512",
    30: "CURVE25519",
    31: "CURVE448",
}
IKEV1_ENCRYPTION = {
    1: "DES_CBC",
    2: "IDEA_CBC",
    3: "BLOWFISH_CBC",
    4: "RC5_R16",
    5: "3DES_CBC",
    6: "CAST_CBC",
    7: "AES_CBC",
    8: "AES_CTR",
}
IKEV1_CIPHER_TRANSFORMS = (1, 5, 7, 8)
IKEV1_AUTH = {
    1: "PSK",
    2: "DSS",
    3: "RSA_SIG",
    4: "RSA_ENC",
    5: "RSA_ENC_REV",
    6: "EL_GAMAL",
    7: "EL_GAMAL_REV",
    8: "ECDSA_SHA",
    9: "X509_SIG",
}
IKEV1_HASH = {1: "MD5", 2: "SHA1"}

# ---- fixed values: weak algorithms -------------------------------------------------------
WEAK_ENCRYPTION = {
    "NULL": "critical",
    "DES": "high",
    "DES_CBC": "high",
    "DES_IV64": "high",
    "DES_IV32": "high",
    "RC5": "high",
    "RC5_R16": "high",
    "IDEA": "high",
    "IDEA_CBC": "high",
    "3IDEA": "high",
    "CAST": "high",
    "CAST_CBC": "high",
    "BLOWFISH": "high",
    "BLOWFISH_CBC": "high",
    "3DES": "medium",
    "3DES_CBC": "medium",
}
SIZED_AES = ("AES_CBC", "AES_CTR", "AES_GCM_16", "AES_GCM_12", "AES_GCM_8")
MIN_AES_KEY_BITS = 128
WEAK_DH = {1: "high", 2: "high", 3: "medium", 22: "high"}

# ---- fixed values: exchange and protocol sets --------------------------------------------
SETUP_EXCHANGES = ("IKE_SA_INIT", "BASE", "IDENTITY_PROTECTION", "AGGRESSIVE")
PROGRESS_EXCHANGES = (
    "IKE_AUTH",
    "CREATE_CHILD_SA",
    "INFORMATIONAL",
    "IKE_SESSION_RESUME",
    "QUICK_MODE",
    "AUTHENTICATION_ONLY",
)
CHILD_EXCHANGES = ("CREATE_CHILD_SA", "QUICK_MODE")
IPSEC_PROTOCOLS = ("ike", "esp", "ah", "natt", "isakmp", "ipsec")
CARRIER_PROTOCOLS = ("ipv4", "ipv6", "arp")
UNKNOWN_MARKERS = ("UNKNOWN", "unknown", "")
UNRESOLVED_PREFIXES = ("INTEG_", "PRF_", "HASH_", "AUTH_", "ALG_")


def lookup_sql(table: dict, key: str) -> str:
    """Value of ``key`` in a fixed table as SQL text, NULL when absent."""

    def literal(value: int | str) -> str:
        return f"'{value}'" if isinstance(value, str) else str(value)

    entries = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items())
    kind = "string" if isinstance(next(iter(table)), str) else "int"
    return f"try_element_at(map({entries}), cast({key} as {kind}))"


def name_or_code_sql(table: dict, key: str, prefix: str) -> str:
    """Registered name, else the prefixed numeric code, as SQL text."""
    return f"coalesce({lookup_sql(table, key)}, concat('{prefix}', cast({key} as string)))"


def lookup(table: dict, key: str) -> Column:
    return F.expr(lookup_sql(table, key))


def is_unknown_value(value: Column) -> Column:
    return value.isNull() | value.isin(*UNKNOWN_MARKERS)


def is_unknown_encryption(value: Column) -> Column:
    return is_unknown_value(value) | value.startswith("ENCR_")


def is_unresolved_transform(value: Column) -> Column:
    prefixed = value.rlike("^(" + "|".join(UNRESOLVED_PREFIXES) + ")")
    return is_unknown_value(value) | prefixed


def weak_encryption_severity(encryption: str = "encryption", key_length: str = "key_length") -> Column:
    """Severity of a weak cipher, NULL for anything not positively weak."""
    sized = ", ".join(f"'{name}'" for name in SIZED_AES)
    return F.expr(
        f"case when {encryption} in ({sized}) "
        f"then case when {key_length} < {MIN_AES_KEY_BITS} then 'high' end "
        f"else {lookup_sql(WEAK_ENCRYPTION, encryption)} end"
    )


def weak_dh_severity(group: str = "dh_group") -> Column:
    return lookup(WEAK_DH, group)


def is_plaintext_protocol(protocol: Column) -> Column:
    return ~protocol.isin(*IPSEC_PROTOCOLS, *CARRIER_PROTOCOLS)
