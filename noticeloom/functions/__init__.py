"""Part of the noticeloom engine."""
