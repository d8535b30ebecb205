"""Views of tables as logs, walks and frames; readers of capture files and log text."""
