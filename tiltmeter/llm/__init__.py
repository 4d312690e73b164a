"""Training-data operators: clean, de-duplicate, fingerprint, tokenise, pack and shard documents."""
