"""Training-data operators: de-duplication, filtering, scanning, sharding and tokenising of document tables."""
