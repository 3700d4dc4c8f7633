"""Training-data operators: archives, near-duplicates, language models, extraction, classifiers, tokens."""
