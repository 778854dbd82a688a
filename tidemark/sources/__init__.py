"""Where records come from: streams, the landing, published runs."""
