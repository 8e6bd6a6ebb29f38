"""Training-data operators: tokenisation, de-duplication, quality, toxicity,
mixing, sharding and nearest-neighbour search over document tables."""
