"""Training-data operators: formatting, deduplication, filtering, mixing,
tokenising and packing of text corpora.  Nothing else in the library imports
this subpackage."""
