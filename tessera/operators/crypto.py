"""An inventory of cryptography by the names that libraries give it, and what a quantum computer leaves of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.inventory import hits

# Fixed: algorithm families with their class and the stems of their names.
FAMILIES = {
    "SM2": ("vulnerable", ("sm2",)), "RSA": ("vulnerable", ("rsa",)), "ECDSA": ("vulnerable", ("ecdsa",)), "ECDH": ("vulnerable", ("ecdh", "ecdhe")), "Ed25519": ("vulnerable", ("ed25519",)),
    "X25519": ("vulnerable", ("x25519", "curve25519")), "DH": ("vulnerable", ("dhm", "dhe", "dh")), "DES/3DES": ("broken", ("des", "des3", "3des")), "RC4": ("broken", ("rc4", "arc4")), "MD5": ("broken", ("md5",)),
    "SHA-1": ("broken", ("sha1",)), "AES": ("symmetric", ("aes",)), "ChaCha20-Poly1305": ("symmetric", ("chacha20", "chacha", "poly1305", "chachapoly")), "SM4": ("symmetric", ("sm4",)), "SHA-256": ("symmetric", ("sha256",)),
    "SHA-384/512": ("symmetric", ("sha384", "sha512")), "SHA-3": ("symmetric", ("sha3", "keccak")), "HMAC": ("symmetric", ("hmac",)), "SM3": ("neutral", ("sm3",)), "HKDF/PBKDF2": ("neutral", ("hkdf", "pbkdf2")),
    "DRBG": ("neutral", ("drbg",)), "ML-KEM": ("pqc", ("mlkem", "ml_kem", "kyber")), "ML-DSA": ("pqc", ("mldsa", "ml_dsa", "dilithium")), "SLH-DSA": ("pqc", ("slhdsa", "slh_dsa", "sphincs")), "LMS/XMSS": ("pqc", ("lms", "xmss")),
}
#: Prefixes under which libraries export a family: the rule that makes a pattern of its stems.
PREFIXES = ("mbedtls_", "wc_", "EVP_", "br_", "tc_", "crypto_", "esp_", "psa_alg_", "psa_key_type_", "config_mbedtls_", "oqs_kem_alg_", "oqs_sig_alg_", "pqclean_", "ossl_", "tpm_alg_", "tpm2_alg_")
#: Verbs that follow a bare stem.
VERBS = ("init", "update", "final", "finish", "sign", "verify", "encrypt", "decrypt", "set_key", "setkey", "setup", "process", "done", "compute_key", "generate_key", "shared_secret", "new", "starts")


def pattern(stems: tuple[str, ...]) -> str:
    """A name of a family: a library's prefix, or a verb after the stem; bounded on the left by what is no word character."""
    stem = "|".join(stems)
    return rf"(?i)(?:^|[^A-Za-z0-9_])(?:(?:{'|'.join(PREFIXES)})(?:{stem})(?:(?-i:[A-Z0-9_])\w*)?\b|(?:{stem})_(?:{'|'.join(VERBS)})\w*)"


#: Whatever a name of any family can begin with, to the end of its word; what follows outside ASCII decides whether the word ends there.
NAMES = rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(PREFIXES)}|(?:{'|'.join(stem for _, stems in FAMILIES.values() for stem in stems)})_)[A-Za-z0-9_]*[^\x00-\x7F]*"
PATTERNS = {name: pattern(stems) for name, (_, stems) in FAMILIES.items()}


def inventory(files: DataFrame) -> DataFrame:
    """``family, class, files, hits, first`` over ``files(path, text)``.

    A match is the beginning of a word, so the words that can match are taken from the text in one pass, and the families read only those.
    """
    names = files.select("path", F.array_join(F.regexp_extract_all("text", F.lit(NAMES), F.lit(0)), "\n").alias("text"))
    found = hits(names, "path", "text", PATTERNS)
    kind = F.element_at(F.create_map(*[x for n, (c, _) in FAMILIES.items() for x in (F.lit(n), F.lit(c))]), F.col("family"))
    return found.groupBy("family").agg(F.count("*").alias("files"), F.sum("n").alias("hits"), F.min("path").alias("first")).withColumn("class", kind)


def readiness(assets: DataFrame) -> DataFrame:
    """``class, action, families`` in the order of what to do first."""
    actions = {"vulnerable": (0, "migrate"), "broken": (1, "replace now"), "symmetric": (2, "keep 256-bit keys"), "neutral": (3, "nothing"), "pqc": (4, "already there")}
    rank, action = F.lit(9), F.lit(None).cast("string")
    for k, (n, text) in actions.items():
        rank = F.when(F.col("class") == k, n).otherwise(rank)
        action = F.when(F.col("class") == k, text).otherwise(action)
    return assets.groupBy("class", rank.alias("rank"), action.alias("action")).agg(F.array_sort(F.collect_set("family")).alias("families")).orderBy("rank").drop("rank")


def failing(assets: DataFrame, classes: tuple[str, ...] = ("vulnerable", "broken")) -> DataFrame:
    return assets.filter(F.col("class").isin(*classes))
