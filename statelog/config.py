"""Constants of the state store and the block scheduler."""

SHARDS = 16
CODE_SHARD = 16
SENTRIES = 4096
OP_READ, OP_WRITE, OP_CREATE, OP_DELETE = 1, 2, 3, 4
#: Leaves of a twig and its levels: 0 leaves, 11 left root, 12 twig root; a twig owns 4096 places at level 0.
TWIG_LEAVES, TWIG_SHIFT, TWIG_LEVEL = 2048, 11, 12
#: Bits of a version that hold the index in its block.
IN_BLOCK_BITS = 24
ENTRY_FIXED = 61
NULL_VERSION = -2
#: Compaction is allowed when the log holds ``COMPACT_FACTOR / COMPACT_DIV`` of the live entries or more, from COMPACT_LEAST entries.
COMPACT_FACTOR, COMPACT_DIV, COMPACT_LEAST = 256, 128, 200_000
PRUNE_EVERY, PRUNE_TWIGS, KEPT_HEIGHTS = 32, 2, 10
BLOOM_FUNCS, BLOOM_BITS, SET_MAX = 5, 2048, 256
BUNDLE_MAX, BUNDLE_MIN, BUNDLES, EARLY_WINDOW = 64, 8, 64, 128
# The wrapped-ether contract, which most transactions write, and the hash of empty bytecode (keccak-256 of nothing).
WETH = "0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2"
EMPTY_CODE_HASH = "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
