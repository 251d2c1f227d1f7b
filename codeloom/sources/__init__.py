"""Where tables come from and go to."""
