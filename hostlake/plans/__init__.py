"""The layers: what each bronze, silver and gold table is made of, and running them."""
